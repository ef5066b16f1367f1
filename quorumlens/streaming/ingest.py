"""Micro-batches of results into keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quorumlens.operators.keyed_log import KeyedLog


def upsert_stream(results: DataFrame, target: KeyedLog, checkpoint: str, order: str | None = None, name: str = "upserts") -> StreamingQuery:
    """Starts a query that upserts each micro-batch; within a batch the last row of a key (by ``order``) counts. A batch that is replayed after a failure is known by
    the stream's name and its number, and changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if order:
            last = F.row_number().over(W.partitionBy(*target.key_columns()).orderBy(F.desc(order)))
            batch = batch.withColumn("_last", last).filter("_last = 1").drop("_last")
        else:
            names = [f"_key_{k}" for k in range(len(target.key))]
            batch = batch.withColumns(dict(zip(names, target.key_columns(), strict=True))).dropDuplicates(names).drop(*names)
        if not batch.isEmpty():
            target.upsert(batch, name, number)

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spending(calls: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Cost of each model in event-time windows, with late calls up to the watermark."""
    return calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))
