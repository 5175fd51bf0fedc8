"""Append-only processing that resumes: what is done already is skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key (such as segment id and hash) hasn't been done."""
    return rows.join(done.select(*key), key, "left_anti")


def resumable(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: list[str]):
    """Starts a stream that appends work(batch) to ``out``, each key once over all batches; a batch that is repeated after a failure replaces itself.

    Each batch writes its keys beside its output, and leaves out those of earlier batches by an anti-join, so that the stream keeps no state.
    """
    def one(batch: DataFrame, number: int) -> None:
        spark, keys = batch.sparkSession, f"{out}_keys"
        new = batch.dropDuplicates(key)
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{keys}/batch=*")
        if pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
            new = pending(new, spark.read.parquet(keys).where(F.col("batch") < number), key)
        work(new).write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.select(*key).write.mode("overwrite").parquet(f"{keys}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
