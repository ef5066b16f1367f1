"""Exact order statistics of groups of any size.

A built-in exact percentile holds every different value of a group in one task. Here a mergeable sketch brackets each wanted rank by two values, one pass counts what lies below a bracket and the
different values within it (both combine on the map side), and the value at the rank is found by running counts over the few values of a bracket. A sketch that
bracketed wrongly is noticed by the counts, and its groups are counted again without brackets, so results never depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.session import written


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """One row a group: ``by``, n (rows with a value) and the wanted percentiles (name: share), interpolated between neighbours as by ``percentile``. Null keys are a group; groups without values have none."""
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    near = 2.0 / accuracy
    cuts = sorted({min(max(q + d, 0.0), 1.0) for q in wanted.values() for d in (-near, near)})
    sketch = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.percentile_approx("_v", [*cuts], accuracy).alias("_cuts"))
    at = lambda q: F.get("_cuts", cuts.index(min(max(q, 0.0), 1.0)))
    position = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = [
        F.struct(
            F.lit(name).alias("name"), F.floor(position(q)).cast("long").alias("rank"), F.ceil(position(q)).cast("long").alias("next"), (position(q) - F.floor(position(q))).alias("part"),
            F.when(F.lit(q <= near), F.col("_least")).otherwise(at(q - near)).alias("low"), F.when(F.lit(q >= 1 - near), F.col("_most")).otherwise(at(q + near)).alias("high"),
        )
        for name, q in wanted.items()
    ]
    brackets = written(sketch.select(*by, "n", F.explode(F.array(*ranks)).alias("r")).select(*by, "n", "r.*"))
    found = written(_at_ranks(known, brackets, by))
    missed = brackets.alias("b").join(found.alias("f"), _same("b", "f", [*by, "name"]), "left_anti")
    if not missed.isEmpty():
        everything = missed.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("nan"))})  # NaN is the greatest value
        found = found.unionByName(_at_ranks(known, everything, by))
    return found.groupBy(*by).pivot("name", list(wanted)).agg(F.first("value")).join(brackets.select(*[F.col(c).alias(f"_{c}") for c in by], "n").distinct(), _same("", "_", by), "inner").select(*by, "n", *wanted)


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equal columns of two aliased tables, or of one table and another whose columns begin with ``_``; null equals null."""
    name = lambda side, c: F.col(f"{side}.{c}" if side not in ("", "_") else f"{side}{c}")
    terms = [name(left, c).eqNullSafe(name(right, c)) for c in columns]
    whole = F.lit(True)
    for t in terms:
        whole = whole & t
    return whole


def _at_ranks(known: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, name, value of the brackets (by, name, n, rank, next, part, low, high) whose two ranks lie within."""
    b = brackets.select(*[F.col(c).alias(f"_{c}") for c in by], "name", "rank", "next", "part", "low", "high")
    # the table of brackets has a few rows a group; each value becomes one row for each wanted rank that its group has, and combines at once
    met = known.join(b, _same("", "_", by)).filter(F.col("_v") <= F.col("high"))
    inside = F.col("_v") >= F.col("low")
    counts = met.groupBy(*by, "name", "rank", "next", "part", F.when(inside, F.col("_v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    running = W.partitionBy(*by, "name").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("end", F.sum("c").over(running)).withColumn("start", F.col("end") - F.col("c"))
    holds = lambda r: F.max(F.when((F.col("start") <= F.col(r)) & (F.col(r) < F.col("end")) & F.col("v").isNotNull(), F.col("v")))
    pair = placed.groupBy(*by, "name", "part").agg(holds("rank").alias("x"), holds("next").alias("y"))
    value = F.when(F.col("part") == 0, F.col("x")).otherwise((1 - F.col("part")) * F.col("x") + F.col("part") * F.col("y"))
    return pair.filter("x is not null and y is not null").select(*by, "name", value.alias("value"))
