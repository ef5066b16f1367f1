"""Scores of labels against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.functions.scores import EMOTIONS, safe_divide
from quorumlens.functions.similarity import long_word_errors, word_errors
from quorumlens.functions.text import tokens


def word_error_rows(panel: DataFrame, long: bool = False) -> DataFrame:
    """panel: id, service, service_output, human and/or oracle: errors, ref_words and word error rate against each reference.

    A reference without words has 0 of them, and the words said are its errors. A panel that has the words of a text already, in a column of its name after an underscore (``_human``: found
    once a sample instead of once a service), keeps them. long: for texts of thousands of words, whose distances are counted a pair at a time; those of sentences are counted many pairs at once.
    """
    kinds = [r for r in ("human", "oracle") if r in panel.columns]
    rows = _in_words(panel, "service_output", *kinds)
    for r in kinds:
        rows = _counted(rows, r, long)
    return rows.drop("_service_output")


def error_rows_by_answer(panel: DataFrame, answers: DataFrame) -> DataFrame:
    """`word_error_rows` of a panel (id, service, service_output, human) against the human and each model's own answer.

    answers: id, ..., oracle. Words are found before rows meet, and errors against the human are counted once for each output, not for each answer to it.
    Rows meet by merging: Spark sees the size of the tables, not of the rows exploded from them, and would send all outputs through the driver where a table is small or well compressed.
    """
    said = _counted(_in_words(panel, "service_output", "human"), "human")
    return _counted(said.join(_in_words(answers, "oracle").hint("merge"), "id"), "oracle").drop("_service_output")


def _in_words(rows: DataFrame, *texts: str) -> DataFrame:
    """The words of texts, each in a column of its name after an underscore, in place of the texts; words that are there already stay."""
    return rows.withColumns({f"_{c}": tokens(F.col(c)) for c in texts if f"_{c}" not in rows.columns}).drop(*texts)


def _counted(rows: DataFrame, r: str, long: bool = False) -> DataFrame:
    """Errors, ref_words and rate against the reference ``r``, in place of its words."""
    errors = (long_word_errors if long else word_errors)(f"_{r}", "_service_output")
    counted = rows.withColumns({f"{r}_errors": errors, f"{r}_ref_words": F.size(f"_{r}").cast("long")}).drop(f"_{r}")
    return counted.withColumn(f"{r}_wer", safe_divide(F.col(f"{r}_errors").cast("double"), F.col(f"{r}_ref_words")))


def word_error_rate(rows: DataFrame, *by: str, name: str = "human") -> DataFrame:
    """Corpus rate: all errors over all reference words, null without any."""
    return rows.groupBy(*by).agg(
        F.sum(f"{name}_errors").alias("errors"), F.sum(f"{name}_ref_words").alias("ref_words"), F.count(F.lit(1)).alias("n_samples"),
        safe_divide(F.sum(f"{name}_errors").cast("double"), F.sum(f"{name}_ref_words")).alias("wer"),
    )


def label_rows(panel: DataFrame) -> DataFrame:
    """correct: 1 where the label equals the (not empty) reference."""
    ref, label = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("reference", "label"))
    return panel.withColumns({"reference": ref, "label": label}).withColumn("correct", ((F.col("reference") != "") & (F.col("reference") == F.col("label"))).cast("int"))


def confusion(rows: DataFrame, *by: str, classes: tuple[str, ...] = EMOTIONS) -> DataFrame:
    """tp, fp, fn and support of each class; rows without reference are left out."""
    counted = rows.filter("reference <> ''").groupBy(*by, "reference", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    is_ref, is_label = F.col("reference") == F.col("class"), F.col("label") == F.col("class")
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    return parts.groupBy(*by, "class").agg(total(is_ref & is_label, "tp"), total(~is_ref & is_label, "fp"), total(is_ref & ~is_label, "fn"), total(is_ref, "support"))


def class_scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn)}).withColumn(
        "f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def classification_summary(rows: DataFrame, *by: str, classes: tuple[str, ...] = EMOTIONS) -> DataFrame:
    """accuracy, macro (over classes with support), micro and support-weighted F1."""
    scored = class_scores(confusion(rows, *by, classes=classes))
    f1 = F.coalesce("f1", F.lit(0.0))
    some = F.col("support") > 0
    tp, fp, fn = (F.sum(c).cast("double") for c in ("tp", "fp", "fn"))
    return scored.groupBy(*by).agg(
        F.sum("support").alias("n"), safe_divide(tp, F.sum("support")).alias("accuracy"), F.avg(F.when(some, f1)).alias("macro_f1"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), safe_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
