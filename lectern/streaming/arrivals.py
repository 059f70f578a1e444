"""Arriving files through the same stages: a file stream, run for what is there and then ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def drain(spark: SparkSession, folder: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], source: str = "parquet") -> None:
    """Hand every file of ``folder`` that was not seen before to ``each`` as a batch with its number, once.

    A batch that fails is handed over again on the next call under the same number, so ``each`` should publish by it.
    """
    stream = spark.readStream.format(source).schema(schema).load(folder)
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    query.awaitTermination()
