"""Keyed tables: upserts, slices, what is still to do, and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.functions.scores import rounded
from quorumlens.functions.text import normalize_id


def same_key(old: str, new: str, key: list[str]) -> Column:
    """Equal keys of two aliased tables, null to null; ids are compared in their normal form."""
    side = lambda alias, c: normalize_id(F.col(f"{alias}.{c}")) if c == "id" else F.col(f"{alias}.{c}")
    first, *rest = [side(old, c).eqNullSafe(side(new, c)) for c in key]
    for x in rest:
        first = first & x
    return first


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` with other keys; missing columns are null."""
    keys = new.select(*key).distinct().alias("n")
    return old.alias("o").join(keys, same_key("o", "n", key), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_slice(ledger: DataFrame, new: DataFrame, column: str, value: str) -> DataFrame:
    """The ledger with one slice (say, a task) replaced."""
    return ledger.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new.filter(F.col(column) == value), allowMissingColumns=True)


def pending(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows that are not done."""
    return planned.alias("p").join(done.select(*key).distinct().alias("d"), same_key("p", "d", key), "left_anti")


def slice_status(planned: DataFrame, done: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """done, total and complete of each slice; keys are compared as in `pending`. A slice is complete if all its keys are there and it has any."""
    marks = done.select(*key).distinct().withColumn("_done", F.lit(1)).alias("d")
    joined = planned.alias("p").join(marks, same_key("p", "d", key), "left").select("p.*", "_done")
    return joined.groupBy(*by).agg(F.count("_done").alias("done"), F.count(F.lit(1)).alias("total")).withColumn("complete", (F.col("done") == F.col("total")) & (F.col("total") > 0))


def progress(slices: DataFrame) -> DataFrame:
    """Totals over slices: jobs done and planned, slices started and complete, percent, status."""
    done, total = F.coalesce(F.sum("done"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))
    return slices.agg(
        done.alias("done"), total.alias("total"), F.count_if(F.col("done") > 0).alias("started"), F.count_if(F.col("done") >= F.col("total")).alias("complete"),
        F.when(total > 0, rounded(100.0 * done / total, 1)).otherwise(0.0).alias("percent"), F.when((total > 0) & (done >= total), "finished").otherwise("incomplete").alias("status"),
    )


def overwrite_slices(new: DataFrame, path: str, *by: str) -> None:
    """Writes ``new`` into the ledger at ``path``, which is partitioned by ``by``: the slices that ``new`` holds are replaced, and no file of another one is touched or read."""
    new.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
