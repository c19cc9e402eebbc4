"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._shared import map_arrow, only


def parsed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, dim, vec (the components' bytes) of the usable vectors.

    Usable: an id, at least one component, all components finite, not all zero. -0.0 becomes 0.0.
    """
    width = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(width) + np.dtype(width).type(0)
        ends = np.cumsum(lengths)
        rows, out = [], []
        for i, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
            v = flat[end - n : end]
            if n and np.isfinite(v).all() and v.any():
                rows.append(i)
                out.append(v.tobytes())
        ids = batch.column(0).take(pa.array(rows, pa.int64()))
        good = ids.is_valid()
        made = pa.RecordBatch.from_arrays([ids, pa.array([len(x) // np.dtype(width).itemsize for x in out], pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])
        return made.filter(good)

    d = only(vectors, vec_id=vec_id, embedding=embedding)
    d = d.withColumn("vec_id", d["vec_id"].cast("long"))
    return map_arrow(d, run, "vec_id long, dim int, vec binary", 4096)


def dtype_of(vectors: DataFrame, embedding: str) -> str:
    return "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"


def matrix(column, dtype: str) -> np.ndarray:
    """Rows of doubles from a column of equally long byte strings without nulls, read from its buffers."""
    rows = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            data = np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            rows.append(np.frombuffer(data.tobytes(), dtype).reshape(len(chunk), -1))
    return np.concatenate(rows).astype(np.float64) if rows else np.empty((0, 0))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal bits wherever they stand."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
