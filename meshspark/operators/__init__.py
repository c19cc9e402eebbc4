"""Operators on meshes, fields, constraints and sparse matrices."""
