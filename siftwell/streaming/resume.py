"""Resumable scoring as a stream of files: each file is scored once, and a rerun goes on where the last one ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_arrivals(spark: SparkSession, inbox: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 64) -> int:
    """Scores what has arrived in `inbox` since the last run and appends it to `out`; returns the number of batches.

    A batch writes to its own folder, so one that is run again after a failure replaces what it wrote before.
    """
    done = []

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    query = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def latest_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The scored rows, each key once, from the last batch that holds it."""
    from siftwell.operators.segment import latest_version

    return latest_version(spark.read.parquet(out), keys, ["batch"]).drop("batch")
