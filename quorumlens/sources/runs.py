"""Runs: tables that may not be there yet, saved samples, and a manifest of what a run was started with."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """A table with a header, or no rows of the same schema where there is no such file or nothing in it."""
    try:
        return spark.read.option("header", True).schema(schema).format(kind).load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def save_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("errorifexists").parquet(path)


def load_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_or_empty(spark, path, schema, "parquet")


def save_manifest(spark: SparkSession, path: str, task: str, settings: Mapping[str, object], status: str = "incomplete") -> None:
    """One document a run: when it began, its task, its settings as JSON, its status. Later states are appended; a run is never changed."""
    row = spark.createDataFrame([(task, json.dumps(settings, sort_keys=True), status)], "task string, settings string, status string")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of a run: task, settings, status, at."""
    rows = read_or_empty(spark, path, "task string, settings string, status string, at timestamp", "parquet")
    return rows.groupBy("task").agg(F.max_by(F.struct("settings", "status"), "at").alias("last"), F.max("at").alias("at")).select("task", "last.*", "at")
