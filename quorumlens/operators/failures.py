"""How often services fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.functions.scores import rounded
from quorumlens.functions.text import is_failed_label, is_failed_text
from quorumlens.operators.store import replace_slice

DETECTORS = {"text": is_failed_text, "emotion": is_failed_label}


def failure_report(panel: DataFrame, task: str, output_kind: str) -> DataFrame:
    """task, service, total_inputs, failed_inputs, failure_rate; a panel without outputs failed throughout."""
    failed = DETECTORS[output_kind](F.col("service_output")) if "service_output" in panel.columns else F.lit(True)
    counted = panel.groupBy("service").agg(F.count(F.lit(1)).alias("total_inputs"), F.count_if(failed).alias("failed_inputs"))
    rate = F.when(F.col("total_inputs") > 0, rounded(F.col("failed_inputs") / F.col("total_inputs"), 4)).otherwise(0.0)
    return counted.select(F.lit(task).alias("task"), "service", "total_inputs", "failed_inputs", rate.alias("failure_rate"))


def combined_report(ledger: DataFrame, report: DataFrame, task: str) -> DataFrame:
    """The ledger of all tasks with this task's rows replaced, worst first."""
    return replace_slice(ledger, report, "task", task).orderBy("task", F.desc("failure_rate"), "service")
