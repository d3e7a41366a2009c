"""Small shared pieces: written intermediate tables, the label split, Arrow text access."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capshift.session import scratch_path


# The scopes around the code that runs; each thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scratch_scopes", default=())


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables written inside are deleted at the end, but those written with ``keep`` (they pass to the scope around)."""
    written: list[str] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(token)
        context = spark.sparkContext
        for path in written:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint root and read it back.

    Cuts the lineage with files every executor can read, so a lost executor costs
    neither the table nor a recomputation of what lies before it.
    """
    path = scratch_path(df.sparkSession, name)
    scopes = _scopes.get()
    at = len(scopes) - 1 - keep
    if at >= 0:
        scopes[at].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of a few short columns as a broadcast side, or as it is (joined by shuffle) beyond ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left",
                small: int = 300_000) -> DataFrame:
    """``rows`` joined with the written table ``groups``, which has one short row per ``key`` and its rows in ``size``.

    Up to ``small`` groups are broadcast. Beyond that, groups that hold a thousandth of
    the ``total`` rows or more (a thousand at most) are still broadcast, so no hot key is
    shuffled; only the other rows are.
    """
    if groups.count() <= small:
        return rows.join(F.broadcast(groups), key, how)
    least = max(total / 1000, 1)
    hot = F.broadcast(groups.where(F.col(size) >= least))
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) < least), key, how)
    return rows.join(hot, key).unionByName(rest)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary file lies (the same package is on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id="doc_id"):
    """Rows kept from label learning: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most about ``per_class`` labelled rows (text, y) of either class, held-out rows excluded.

    The fraction kept of a class is computed from its exact count and applied to a
    hash of the id, so the sample is the same in every run. ``per_class`` bounds
    what the trainer collects; scoring is not limited by it.
    """
    rows = labels.where(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    spread = (F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) / (1 << 30)).cast("double")
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    picked = F.broadcast(rows.where(spread <= share))  # about 2 x per_class rows of two numbers
    return docs.select("doc_id", "text").join(picked, "doc_id").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


def collect_training(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """The bounded sample on the driver, in a fixed order."""
    table = sample.toArrow()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "y"))))
    return [r[1] for r in rows], np.array([r[2] for r in rows], np.float64)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null read as empty."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker serves many tasks and would keep the most it ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_slices(batches, rows: int = 512):
    """Arrow batches cut into slices of at most ``rows`` rows, so that what Python holds at once stays small."""
    release_memory()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    release_memory()
