"""Recorded judgements: long rows, validity, the human in the loop, and agreement with references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.functions.scores import confidence
from quorumlens.operators.quantiles import exact_percentiles

UNSCORED = -1.0


def usable(winner: Column, scores: Column, services: Column) -> Column:
    """The winner is one of the services and some score is 0 or more. scores: a map of texts; `number_scores` makes one of a JSON answer."""
    return F.coalesce(F.array_contains(services, winner) & F.exists(F.map_values(scores), lambda v: F.coalesce(v.try_cast("double") >= 0, F.lit(False))), F.lit(False))


def number_scores(answer: Column, path: str = "$.scores") -> Column:
    """map<string,string> of the scores of a JSON answer that are numbers as JSON has them: quoted numbers and booleans are none."""
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(answer), path, "map<string,variant>"))
    numbers = F.filter(entries, lambda e: F.schema_of_variant(e["value"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    return F.map_from_entries(F.transform(numbers, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value"))))


def known_winners(answers: DataFrame, services: list[str]) -> DataFrame:
    """Answers with null for a winner that is none of the services."""
    return answers.withColumn("winner", F.when(F.col("winner").isin(services), F.col("winner")))


def judge_rows(answers: DataFrame, services: list[str]) -> DataFrame:
    """One row for each service: score (-1 where it was not rated), is_winner; an unknown winner is null.

    answers: prompt, model, id, llm_label, winner, scores (map of texts), ...
    """
    long = known_winners(answers, services).withColumn("service", F.explode(F.array(*map(F.lit, services))))
    score = F.coalesce(F.col("scores")[F.col("service")].try_cast("double"), F.lit(UNSCORED))
    return long.withColumns({"score": score, "is_winner": F.coalesce(F.col("winner") == F.col("service"), F.lit(False))}).drop("scores")


def with_fallback(judged: DataFrame, human: DataFrame, best: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Below the threshold the human label counts (the model's, if that is blank) and the winner is the objectively best service.

    judged: id, confidence (text), llm_label, winner; human: id, human_label; best: id, best_service.
    """
    joined = judged.join(human, "id", "left").join(best, "id", "left")
    sure = confidence(F.col("confidence"))
    used = (sure < threshold) & ~F.isnan(sure)
    blank = F.trim(F.coalesce("human_label", F.lit(""))) == ""
    return joined.withColumns({"confidence": sure, "fallback_used": used}).withColumns(
        {
            "final_label": F.when(F.col("fallback_used") & ~blank, F.col("human_label")).otherwise(F.col("llm_label")),
            "final_winner": F.when(F.col("fallback_used"), F.when(~blank, F.col("best_service"))).otherwise(F.col("winner")),
        }
    )


def best_service(rows: DataFrame, metric: str, higher_is_better: bool, *by: str) -> DataFrame:
    """The service with the best metric, the first in order of equals. No filter on the metric, which would go below its making and make it twice."""
    value = F.col(metric)
    place = F.struct(value.isNull().alias("none"), (-value if higher_is_better else value).alias("metric"), "svc_ord", "service")
    return rows.groupBy(*by).agg(F.min(place).alias("first")).filter(~F.col("first.none")).select(*by, F.col("first.service").alias("best_service"))


def best_sets(rows: DataFrame, metric: str, higher_is_better: bool, *by: str) -> DataFrame:
    """All services that share the best metric, as a sorted array."""
    best = (F.max if higher_is_better else F.min)(metric).over(W.partitionBy(*by))
    return rows.withColumn("top", best).filter(F.col(metric) == F.col("top")).groupBy(*by).agg(F.array_sort(F.collect_set("service")).alias("best"))


def per_sample(judged: DataFrame) -> DataFrame:
    """One row for each (prompt, model, id) of long rows."""
    return judged.dropDuplicates(["prompt", "model", "id"])


def winner_agreement(samples: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    """The share of winners that are among the best services; samples without winner are left out, without best set wrong."""
    voted = samples.filter("winner is not null and winner <> ''").join(sets, "id", "left")
    right = F.coalesce(F.array_contains("best", F.col("winner")), F.lit(False)).cast("int")
    return voted.groupBy(*by).agg(F.avg(right).alias("agreement"), F.count(F.lit(1)).alias("n"))


def win_rates(samples: DataFrame) -> DataFrame:
    """n_wins and win_rate of each winner within (prompt, model)."""
    won = samples.filter("winner is not null and winner <> ''").groupBy("prompt", "model", "winner").agg(F.count(F.lit(1)).alias("n_wins"))
    return won.withColumn("win_rate", F.col("n_wins") / F.sum("n_wins").over(W.partitionBy("prompt", "model")))


def fallback_rates(samples: DataFrame) -> DataFrame:
    return samples.groupBy("prompt", "model").agg(F.avg(F.coalesce("fallback_used", F.lit(False)).cast("int")).alias("fallback_rate"))


def score_distribution(rows: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of the scores of each service, by prompt and over all prompts. Quartiles are exact, and no group's values meet in one task."""
    rated = rows.filter("score >= 0").select("prompt", "model", "service", "score")
    parts = []
    for scope, by in (("per_prompt", ["prompt", "model", "service"]), ("all_prompts", ["model", "service"])):
        moments = rated.groupBy(*by).agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.min("score").alias("low"), F.max("score").alias("high"))
        quarts = exact_percentiles(rated, by, "score", {"p25": 0.25, "median": 0.5, "p75": 0.75}).withColumnsRenamed({c: f"_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        whole = moments.join(quarts, same, "inner").withColumn("scope", F.lit(scope))
        parts.append(whole if scope == "per_prompt" else whole.withColumn("prompt", F.lit("<all>")))
    columns = ["prompt", "model", "service", "n", "mean", "std", "low", "p25", "median", "p75", "high", "scope"]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns))


def histogram(values: DataFrame, column: str, *by: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins of 0 to 1, the last one closed; edges are multiples of the width as doubles."""
    width = 1.0 / bins
    edges = F.array(*[F.lit(i * width) for i in range(1, bins)])
    bin_ = F.size(F.filter(edges, lambda e: e <= F.col(column))).cast("long")
    return values.filter(F.col(column).between(0, 1)).groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def split_prompt(prompt: Column, suffix: str = "__no-threshold") -> tuple[Column, Column]:
    """Whether the threshold holds, and the prompt's plain name."""
    without = F.endswith(prompt, F.lit(suffix))
    return F.when(without, "no-threshold").otherwise("threshold"), F.regexp_replace(prompt, f"{suffix}$", "")
