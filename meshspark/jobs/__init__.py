"""Registered queries of the mesh operators and their SQL."""

from .more import QUERIES as MORE
from .more_oracle import SQL as MORE_SQL
from .oracle import SQL
from .systems import QUERIES as SYSTEMS
from .systems_oracle import SQL as SYSTEMS_SQL
from .work import QUERIES


def queries() -> dict:
    return QUERIES | MORE | SYSTEMS


def oracle_sql() -> dict:
    return SQL | MORE_SQL | SYSTEMS_SQL
