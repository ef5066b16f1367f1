"""Cost ledgers: one row for each call, priced by joins to small price tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.functions.scores import RATE_KEYS, model_price, service_price


def priced_model_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, input_tokens, output_tokens, audio_input_tokens) with cost_usd; prices: model, rate_in, rate_out, rate_audio."""
    joined = calls.join(prices, "model", "left")
    cost = model_price(*map(F.col, ("input_tokens", "output_tokens", "audio_input_tokens", "rate_in", "rate_out", "rate_audio")))
    return joined.withColumn("cost_usd", cost).drop("rate_in", "rate_out", "rate_audio")


def priced_service_calls(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (task, service, usage) with cost_usd and unit; prices: task, service and any of the price keys as columns."""
    joined = calls.join(prices, ["task", "service"], "left")
    usage = {kind: F.col("usage") for kind in ("minutes", "characters", "count")}
    cost, unit = service_price(usage, {key: F.col(key) for key, _, _ in RATE_KEYS if key in prices.columns})
    return joined.withColumns({"cost_usd": cost, "unit": unit}).drop(*[key for key, _, _ in RATE_KEYS])


def total(column: str):
    """A sum in millionths, so that it does not depend on the order; 0 for nothing."""
    return (F.coalesce(F.sum(F.round(F.col(column).cast("decimal(28,6)"), 6)), F.lit(0)).cast("decimal(28,6)")).cast("double")


def model_summary(ledger: DataFrame) -> DataFrame:
    """calls, tokens, cost and mean latency by task, paradigm, model and status (nulls are groups too)."""
    return ledger.groupBy("task", "paradigm", "model", "status").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        total("cost_usd").alias("cost_usd"), F.round(F.avg(F.col("latency_ms").cast("decimal(18,4)")), 2).cast("double").alias("latency_ms"),
    )


def service_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("task", "service").agg(F.count(F.lit(1)).alias("calls"), total("usage").alias("usage"), total("cost_usd").alias("cost_usd"))


def cost_by_model(ledger: DataFrame) -> DataFrame:
    """All and successful spending of each model; negative or missing costs are left out. Rows without status succeeded."""
    valid = ledger.filter("cost_usd >= 0").withColumn("good", F.when(F.coalesce("status", F.lit("success")) == "success", F.col("cost_usd")))
    return valid.groupBy("model").agg(total("cost_usd").alias("total_usd"), total("good").alias("successful_usd"))


def cost_rollup(models: DataFrame, services: DataFrame) -> DataFrame:
    """Costs of both ledgers by kind and task, by kind, and altogether (the levels of one rollup)."""
    both = models.select(F.lit("model").alias("kind"), "task", "cost_usd").unionByName(services.select(F.lit("service").alias("kind"), "task", "cost_usd"))
    rolled = both.rollup("kind", "task").agg(total("cost_usd").alias("cost_usd"), F.grouping_id().alias("level"))
    return rolled.select(F.coalesce("kind", F.lit("<all>")).alias("kind"), F.when(F.col("level") > 0, "<all>").otherwise(F.col("task")).alias("task"), "cost_usd", F.col("level").cast("long").alias("level"))


def invocation_cost(models: DataFrame, services: DataFrame) -> DataFrame:
    """Cost of each entity, models as ``llm:name``, with its share of all (null if nothing was spent); a handful of entities meet for the total."""
    both = models.select(F.concat(F.lit("llm:"), F.col("model")).alias("entity"), "cost_usd").unionByName(services.select(F.col("service").alias("entity"), "cost_usd"))
    spent = both.groupBy("entity").agg(total("cost_usd").alias("cost_usd"))
    grand = spent.agg(total("cost_usd").alias("grand"))
    return spent.crossJoin(F.broadcast(grand)).select("entity", "cost_usd", F.when(F.col("grand") > 0, F.col("cost_usd") / F.col("grand")).alias("share"))  # one row


def settled_attempts(attempts: DataFrame) -> DataFrame:
    """Of the attempts (task, model, id, attempt, ok, cost_usd) of a call, the first valid or else the last, with the cost of all."""
    best = F.max_by(F.struct("attempt", "ok", "content"), F.struct("ok", F.when(F.col("ok"), -F.col("attempt")).otherwise(F.col("attempt")).alias("o")))
    priced = F.round(F.sum(F.col("cost_usd").cast("decimal(28,6)")), 6).cast("double")
    return attempts.groupBy("task", "model", "id").agg(best.alias("best"), F.count(F.lit(1)).alias("attempts"), priced.alias("cost_usd")).select(
        "task", "model", "id", F.col("best.attempt").alias("attempt"), F.when(F.col("best.ok"), "success").otherwise("failed").alias("status"), F.col("best.content").alias("content"), "attempts", "cost_usd"
    )
