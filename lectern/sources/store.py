"""Versioned tables with atomic wholesale replacement by book, and tables of records whose latest row counts.

A stage writes its rows under a new version and then appends a pointer ``(stage, book_id, version, seq)``; readers take
the rows of each book's latest pointer.  A failed stage leaves the old pointer; an empty result is a pointer to no rows.
"""

from __future__ import annotations

import contextlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "stage string, book_id string, version string, seq bigint"
RUNS = "run_id string, seq bigint, scope string, book_id string, status string, error string, at timestamp, input_tokens bigint, output_tokens bigint, model_version string, prompt_version string"


class Store:
    """Stage outputs, run records and the vector table's metadata under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def _read(self, path: str, schema) -> DataFrame:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def pointers(self) -> DataFrame:
        latest = self._read(self._path("pointers"), POINTERS).groupBy("stage", "book_id").agg(F.max_by("version", "seq").alias("version"))
        return latest

    def publish(self, stage: str, version: str, seq: int, books: DataFrame, rows: DataFrame) -> None:
        """Replace a stage's rows of ``books`` (book_id) by ``rows``; the pointer is written last."""
        rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(self._path("stages", stage))
        named = books.select("book_id").distinct().select(F.lit(stage).alias("stage"), "book_id", F.lit(version).alias("version"), F.lit(seq).cast("bigint").alias("seq"))
        named.write.mode("append").parquet(self._path("pointers"))

    def append(self, stage: str, rows: DataFrame) -> None:
        """Add rows to a table that keeps its history."""
        rows.write.mode("append").parquet(self._path("history", stage))

    def history(self, stage: str, schema) -> DataFrame:
        return self._read(self._path("history", stage), schema)

    def stage(self, stage: str, schema) -> DataFrame:
        """The published rows of a stage: each book's latest version."""
        rows = self._read(self._path("stages", stage), schema.add("version", "string") if hasattr(schema, "add") else f"{schema}, version string")
        current = self.pointers().where(F.col("stage") == stage).select("book_id", "version")
        return rows.join(current, ["book_id", "version"]).drop("version")

    def put(self, name: str, rows: DataFrame, seq: int) -> None:
        """Add or replace records of a table; nothing is rewritten, so a failure leaves the table as it was."""
        rows.withColumn("seq", F.lit(seq).cast("bigint")).write.mode("append").parquet(self._path("records", name))

    def records(self, name: str, schema: str, key: str) -> DataFrame:
        """The latest row of every record."""
        rows = self._read(self._path("records", name), f"{schema}, seq bigint")
        columns = [c for c in rows.columns if c != "seq"]
        latest = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), "seq").alias("__row"))
        return latest.select("__row.*")

    def runs(self) -> DataFrame:
        """The latest record of each book's run."""
        rows = self._read(self._path("runs"), RUNS)
        return rows.groupBy("run_id", "book_id").agg(*[F.max_by(c, "seq").alias(c) for c in rows.columns if c not in ("run_id", "book_id", "seq")])

    def record(self, rows: DataFrame) -> None:
        """Append run records; columns that are not given are null."""
        names = [c.split()[0] for c in RUNS.split(", ")]
        rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (f.split() for f in RUNS.split(", "))]).select(*names).write.mode("append").parquet(self._path("runs"))

    def write_log(self, lines: DataFrame, run_id: str) -> None:
        """One text for each book of a run under ``logs``; a log that can't be written stops nothing."""
        with contextlib.suppress(Exception):
            ordered = lines.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("value"))
            ordered.write.mode("append").partitionBy("book_id").text(self._path("logs", f"run={run_id}"))

    def vector_model(self) -> DataFrame:
        return self._read(self._path("vector_meta"), "embedding_model string")

    def lock_vectors(self, model: str) -> None:
        """Record the embedding model of a new vector table, or check the recorded one."""
        from lectern.operators.search import verified_model

        if not verified_model(self.vector_model(), model):
            self.spark.createDataFrame([(model,)], "embedding_model string").write.mode("append").parquet(self._path("vector_meta"))
