"""Continuous upsert of crawled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from specstrata.operators.corpus import merge_crawls


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Merge every micro-batch of ``stream`` into versions of a parquet table under ``target``.

    Each batch writes ``target/v=N`` whole, so a batch that is repeated after a
    failure overwrites its own version and readers keep the one before.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(keys)
        old = spark.read.parquet(f"{target}/v={number - 1}") if number else new.limit(0)
        merge_crawls(new, old, keys).write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
