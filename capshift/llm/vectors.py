"""Embedding rows as Spark tables: which take part, and their raw single-precision bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capshift.llm.common import in_slices, materialise


def usable(table: DataFrame, with_id: bool = False) -> DataFrame:
    """(row, vec_id, dim, raw): rows whose vector is not null, empty or zero and holds only finite numbers."""
    def run(batches):
        for part in in_slices(batches, 4096):
            keep, raw, dim = [], [], []
            for vector in part.column(1).to_pylist():
                values = None if vector is None or None in vector else np.array(vector, np.float64)
                good = values is not None and len(values) > 0 and bool(np.isfinite(values).all()) and bool(values.any())
                keep.append(good)
                raw.append(values.tobytes() if good else None)
                dim.append(len(values) if good else 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())],
                ["vec_id", "dim", "raw"]).filter(pa.array(keep))

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    if with_id:
        rows = rows.where(F.col("vec_id").isNotNull())
    return materialise(rows.mapInArrow(run, "vec_id long, dim int, raw binary")
                       .withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Raw double vectors of one length as rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component, so that squares neither overflow nor vanish)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
