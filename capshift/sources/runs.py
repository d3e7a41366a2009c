"""Chained runs: what a run leaves becomes visible all at once and is where the next one starts.

A run writes its tables to folders of its own and then publishes one small commit
record, ``_commits/<number>.json``, moved into place by a rename. Readers go by the
records: folders of a run that died half way are never read, and are written over when
the run is started again. Numbers follow each other, so a run that was overtaken by
another one finds its number taken and fails instead of building on an old state.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capshift import schemas

# Folders of runs that read back as written when they are taken as partition values.
PLAIN_FOLDER = re.compile(r"run_id=(?!__HIVE_DEFAULT_PARTITION__$)[^%/]+")

COMMIT = T.StructType([
    T.StructField("number", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("as_of", T.TimestampNTZType()),
    T.StructField("tables", T.MapType(T.StringType(), T.StringType())),
])


class RunStore:
    """The published runs under ``root``, a folder that all executors and the driver share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_commits"

    def _fs(self, path: str):
        context = self.spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(context._jsc.hadoopConfiguration()), where

    def commits(self) -> DataFrame:
        """One row (COMMIT) per published run."""
        fs, folder = self._fs(self.folder)
        if not fs.exists(folder):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(self.folder)

    def find(self, run_id: str) -> dict | None:
        row = self.commits().where(F.col("run_id") == run_id).first()
        return row.asDict() if row else None

    def latest(self) -> dict | None:
        """The newest record, found by its name; only that file is read."""
        fs, folder = self._fs(self.folder)
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        names = sorted(n for n in names if n.endswith(".json") and not n.startswith("_"))
        if not names:
            return None
        return self.spark.read.schema(COMMIT).json(f"{self.folder}/{names[-1]}").first().asDict()

    def state(self, initial: DataFrame | None = None) -> DataFrame:
        """The repoint state that the newest run left (``initial`` or no rows before the first)."""
        last = self.latest()
        if last is not None:
            return self.spark.read.schema(schemas.REPORT_REPOINTS).parquet(last["tables"]["report_repoints"])
        return initial if initial is not None else self.spark.createDataFrame([], schemas.REPORT_REPOINTS)

    def table(self, name: str) -> DataFrame:
        """K4, K5: the rows of one output of all published runs, with their ``run_number`` and ``run_id``."""
        runs = self.commits().select("number", "run_id", F.col("tables")[name].alias("path")).where("path is not null")
        paths = [r["path"] for r in runs.orderBy("number").collect()]  # one short row per run
        if not paths:
            raise LookupError(f"no published run has written {name}")
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        rows = reader.parquet(*paths)
        known = runs.select("number", F.col("run_id").alias("_run"), F.regexp_extract("path", r"/([^/]*)/?$", 1).alias("_name"))
        # a file belongs to the run whose folder it lies in
        folders = [path.rstrip("/").rsplit("/", 1)[-1] for path in paths]
        if all(PLAIN_FOLDER.fullmatch(folder) for folder in folders):
            # the folder is a partition value, one constant a file; as text, so that 007 stays 007
            as_text = T.StructType([f for f in rows.schema if f.name != "run_id"] + [T.StructField("run_id", T.StringType())])
            keyed = reader.schema(as_text).parquet(*paths)
            keyed = keyed.withColumn("_name", F.concat(F.lit("run_id="), F.col("run_id"))).drop("run_id")
        else:
            # by file path, taken apart for every row; file paths are given URL-encoded
            folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*)/[^/]*$", 1)
            keyed = rows.withColumn("_name", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).drop("run_id")
        return keyed.join(F.broadcast(known), "_name").drop("_name").withColumnsRenamed({"number": "run_number", "_run": "run_id"})

    def publish(self, run) -> dict:
        """Write all outputs of a ``BalanceRun`` and publish them; a run already published is left as it is.

        What the run kept in the scratch folder for itself is deleted once it is published.
        """
        done = self.find(run.params.run_id)
        if done is not None:
            return done
        last = self.latest()
        number = last["number"] + 1 if last else 1
        tables = run.write(self.root)
        record = {"number": number, "run_id": run.params.run_id, "as_of": run.params.as_of.isoformat(), "tables": tables}
        self._place(f"{number:012d}.json", json.dumps(record))
        run.release()
        return self.find(run.params.run_id)

    def _place(self, name: str, text: str) -> None:
        fs, target = self._fs(f"{self.folder}/{name}")
        _, draft = self._fs(f"{self.folder}/_{name}.draft")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"{target.toString()} is taken: another run was published meanwhile")
