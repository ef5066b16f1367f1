"""Composed passes: what is pending is asked of a provider, parsed, validated and merged into the keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.functions.text import answer, fill_template, is_nullish, json_fields
from quorumlens.operators.judging import judge_rows, usable
from quorumlens.operators.panel import service_block
from quorumlens.operators.store import pending

#: The field that holds a task's own answer, by paradigm.
ANSWER_KEYS = {"asr": "transcript", "mt": "translation", "fer": "scores"}
LABEL_KEYS = {"asr": "llm_transcript", "mt": "llm_translation", "fer": "llm_emotion"}
KEY = ["prompt", "model", "id"]


def oracle_pass(work: DataFrame, done: DataFrame, ask: Callable[[DataFrame], DataFrame], task: str, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """The table of a model's own answers after one pass. work: prompt, model, id; done: prompt, model, id, llm_oracle, status.

    ask: adds ``content`` to rows of work, as a provider or a table of recorded answers does. Missing answers are kept as failed, so that they are billed once.
    """
    asked = ask(pending(work, done, KEY))
    said = answer(F.col("content"), ANSWER_KEYS[task])
    said = transform(said) if transform else said
    rows = asked.select(*KEY, said.alias("llm_oracle")).withColumn("status", F.when(is_nullish(F.col("llm_oracle")), "failed").otherwise("success"))
    return done.unionByName(rows, allowMissingColumns=True)  # what was pending is not in done, so nothing is replaced


def as_service(answers: DataFrame, name: str = "llmaas", transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """A model's answers as the outputs of one more service."""
    said = F.coalesce("llm_oracle", F.lit(""))
    return answers.withColumns({"service": F.lit(name), "service_output": transform(said) if transform else said})


def own_and_model_rows(rows: DataFrame, name: str = "llmaas") -> tuple[DataFrame, DataFrame]:
    """Rows of services, and rows of models as services."""
    return rows.filter(~F.col("service").eqNullSafe(name)), rows.filter(F.col("service") == name)


def judge_prompts(panel: DataFrame, template: str, **values: Column) -> DataFrame:
    """id and the text that asks a model to judge a sample's outputs."""
    blocks = service_block(panel)
    return blocks.select("id", fill_template(F.lit(template), service_blocks=F.col("service_blocks"), **values).alias("asked"))


def judge_pass(work: DataFrame, done: DataFrame, ask: Callable[[DataFrame], DataFrame], services: list[str], task: str = "asr") -> DataFrame:
    """The long table of judgements after one pass: prompt, model, id, llm_label, winner, confidence, service, score, is_winner, usable.

    work: prompt, model, id and whatever ``ask`` needs; done: the table so far.
    """
    asked = ask(pending(work, done, KEY))
    fields = json_fields(F.col("content"))
    parsed = asked.select(*KEY, fields[LABEL_KEYS[task]].alias("llm_label"), fields["winner"].alias("winner"), fields["confidence"].alias("confidence"), F.from_json(fields["scores"], "map<string,string>").alias("scores"))
    listed = F.array(*map(F.lit, services))
    parsed = parsed.withColumn("usable", usable(F.col("winner"), F.col("scores"), listed))
    return done.unionByName(judge_rows(parsed, services), allowMissingColumns=True)  # as in `oracle_pass`


def last_scores(accuracy: DataFrame, score: str, order: str) -> DataFrame:
    """id, service and the stored score; of several rows the last counts, missing ones don't."""
    last = F.row_number().over(W.partitionBy("id", "service").orderBy(F.desc(order)))
    return accuracy.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_n", last).filter("_n = 1").drop("_n")


def first_match(panel: DataFrame, truth: str = "reference", said: str = "label") -> DataFrame:
    """id and the first service, in order, whose answer is the human label; none where no service is right."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    right = panel.filter((plain(truth) != "") & (plain(truth) == plain(said)))
    return right.groupBy("id").agg(F.min_by("service", "svc_ord").alias("best_service"))
