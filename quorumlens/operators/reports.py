"""Report frames: accuracies by entity, prompt and reference, label accuracy and consistency of the paradigms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.functions.scores import safe_divide
from quorumlens.operators.judging import best_sets, winner_agreement


@dataclass(frozen=True)
class TaskMetric:
    """What a task is measured by: the metric of a row, whether low is good, and what counts as correct."""

    metric: str
    lower_is_better: bool
    correct_from: float | None = None

    def goodness(self, value: Column) -> Column:
        return 1.0 - value if self.lower_is_better else value

    def is_correct(self, value: Column) -> Column:
        """The optional threshold on a row's metric."""
        if self.correct_from is None:
            return value == 1
        return value <= self.correct_from if self.lower_is_better else value >= self.correct_from


#: The metric of each task, its direction and its threshold.
TASKS = {"asr": TaskMetric("human_wer", True, 0.30), "mt": TaskMetric("human_comet", False, 0.70), "fer": TaskMetric("human_correct", False)}


def accuracy_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Corpus error rates against the human and the oracle reference. rows: human_errors, human_ref_words, oracle_errors, oracle_ref_words."""
    rate = lambda r: safe_divide(F.sum(f"{r}_errors").cast("double"), F.sum(f"{r}_ref_words")).alias(f"{r}_wer")
    return rows.groupBy(*by).agg(rate("human"), rate("oracle"), F.count(F.lit(1)).alias("n_samples"))


def entity_accuracy(services: DataFrame, models: DataFrame, metric: str, *by: str) -> DataFrame:
    """Mean metric of services and of models (as ``llm:name``), of the same kind of rows; by prompt, if asked."""
    mean = lambda df, entity, kind: df.groupBy(entity.alias("entity"), *by).agg(F.avg(metric).alias("value")).withColumn("kind", F.lit(kind))
    return mean(services, F.col("service"), "service").unionByName(mean(models, F.concat(F.lit("llm:"), "model"), "llm"))


def accuracy_by_prompt(summary: DataFrame, models: DataFrame, metric: str = "human_wer") -> DataFrame:
    """entity, prompt, value: services once (their metric does not depend on the prompt: ``<all>``), models by prompt."""
    services = summary.filter(F.col(metric).isNotNull()).groupBy(F.col("service").alias("entity")).agg(F.avg(metric).alias("value"))
    llm = models.filter(F.col(metric).isNotNull()).groupBy(F.concat(F.lit("llm:"), "model").alias("entity"), "prompt").agg(F.avg(metric).alias("value"))
    return services.select("entity", F.lit("<all>").alias("prompt"), "value").unionByName(llm)


def accuracy_vs_reference(summary: DataFrame, metric: str = "oracle_wer") -> DataFrame:
    """model, service, prompt, value: services against each model's own answers."""
    return summary.groupBy("model", "service", "prompt").agg(F.avg(metric).alias("value"))


def reference_consistency(summary: DataFrame, *hue: str) -> DataFrame:
    """service, ``hue``, reference, value: the human beside the oracle reference, altogether or by model or prompt; the human one does not depend on these."""
    if not hue:
        long = summary.unpivot(["service"], ["human_wer", "oracle_wer"], "reference", "value")
        return long.groupBy("service", F.regexp_replace("reference", "_wer$", "").alias("reference")).agg(F.avg("value").alias("value"))
    human = summary.groupBy("service").agg(F.avg("human_wer").alias("value")).select("service", *[F.lit("<all>").alias(h) for h in hue], F.lit("human").alias("reference"), "value")
    return human.unionByName(summary.groupBy("service", *hue).agg(F.avg("oracle_wer").alias("value")).withColumn("reference", F.lit("oracle")))


def value_range(frame: DataFrame, value: str = "value") -> DataFrame:
    """Lowest and highest value of a frame, without nulls and NaN."""
    real = F.when(~F.isnan(value), F.col(value))
    return frame.agg(F.min(real).alias("low"), F.max(real).alias("high"))


def different(frame: DataFrame, *columns: str) -> DataFrame:
    """How many prompts, models and so on a report averages over; null is none of them."""
    return frame.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def paradigm_consistency(rows: DataFrame, judged: DataFrame, looped: DataFrame, voted: DataFrame, task: TaskMetric = TASKS["asr"]) -> DataFrame:
    """paradigm, model, score: how often winners are among the best services by the human reference, and the mean agreement of the vote.

    rows: id, service and the task's metric; judged, looped: one row for each (prompt, model, id) with winner. Of the human loop, rows
    that fell back to the human and prompts without threshold are left out.
    """
    sets = best_sets(rows, task.metric, not task.lower_is_better, "id")
    own = looped.filter(~F.coalesce("fallback_used", F.lit(False)) & ~F.endswith("prompt", F.lit("__no-threshold")))
    both = [df.select(F.lit(name).alias("paradigm"), "model", "id", "winner") for name, df in (("judge", judged), ("human_loop", own))]
    won = winner_agreement(both[0].unionByName(both[1]), sets, "paradigm", "model").select("paradigm", "model", F.col("agreement").alias("score"))  # the best sets are made once
    vote = voted.agg(F.avg("agreement").alias("score")).select(F.lit("majority_voting").alias("paradigm"), F.lit("(no LLM)").alias("model"), "score")
    return won.unionByName(vote)


def label_accuracy(rows: DataFrame, models: DataFrame | None, judged: DataFrame, looped: DataFrame, voted: DataFrame, task: TaskMetric = TASKS["asr"]) -> DataFrame:
    """As `paradigm_consistency`, with the models' own answers first.

    models: prompt, model and the task's metric of the models as services (``llmaas``). Without it the services' mean by (prompt, model) stands in, as ``oracle``.
    """
    own = models.groupBy("model").agg(F.avg(task.metric).alias("m")) if models is not None else rows.groupBy("prompt", "model").agg(F.avg(task.metric).alias("m"))
    first = own.filter("m is not null").select(F.lit("oracle" if models is None else "llmaas").alias("paradigm"), "model", task.goodness(F.col("m")).alias("score"))
    return first.unionByName(paradigm_consistency(rows, judged, looped, voted, task))


def smoke_matrix(cells: DataFrame, models: list[str]) -> DataFrame:
    """One row a prompt, one column a model with its worst status (failed, skipped, ok)."""
    worst = F.min(F.when(F.col("status") == "failed", 0).when(F.col("status").isNull(), 1).otherwise(2))
    wide = cells.groupBy("prompt").pivot("model", models).agg(worst)
    return wide.select("prompt", *[F.get(F.array(F.lit("failed"), F.lit("skipped"), F.lit("ok")), F.col(m)).alias(m) for m in models])
