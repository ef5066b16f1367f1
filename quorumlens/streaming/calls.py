"""Streams of calls and answers in event time: repeated deliveries dropped, calls met with their answers, and what came too late counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once(stream: DataFrame, *key: str, time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """The first delivery of each key; state of a key is kept for ``late`` of event time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def answered(calls: DataFrame, answers: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Calls (call_id, asked, ...) with the answers (call_id, answered, ...) that came within an interval; calls without one come out with nulls, once the watermark has passed.

    Streams have watermarks on asked and answered (`once` sets one), which with the interval bound the state of both sides. On tables the result is the same, and comes at once.
    """
    x, y = calls.alias("c"), answers.alias("a")
    met = (F.col("c.call_id") == F.col("a.call_id")) & (F.col("a.answered") >= F.col("c.asked")) & (F.col("a.answered") <= F.col("c.asked") + F.expr(f"interval {within}"))
    rest = [f"a.{c}" for c in answers.columns if c != "call_id"]
    return x.join(y, met, "leftOuter").select("c.*", *rest)


def too_late(query: StreamingQuery) -> int:
    """Rows that stateful operators have dropped for coming after the watermark, over the batches that the query remembers."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends all there is to ``path``, batch by batch, and then ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
