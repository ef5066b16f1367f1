"""Votes over panels and the disagreement that ranks samples. A panel holds a handful of services, so pairs are made within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.functions.scores import rounded
from quorumlens.functions.similarity import later_ratios, ordered_ratios
from quorumlens.functions.text import squeeze
from quorumlens.session import spread, written


def ballots(panel: DataFrame, normalize=squeeze) -> DataFrame:
    """id and its outputs, normalised, in service order."""
    in_order = F.array_sort(F.collect_list(F.struct("svc_ord", normalize(F.col("service_output")).alias("label"))))
    return panel.groupBy("id").agg(F.transform(in_order, lambda x: x["label"]).alias("ballots"))


def _votes(labels: Column) -> Column:
    """struct<n, -position, label> of each different label that is not empty; the greatest wins, the first of equals."""
    some = F.filter(labels, lambda x: x != "")
    return F.transform(F.array_distinct(some), lambda x: F.struct(F.size(F.filter(some, lambda y: y == x)).alias("n"), (-F.array_position(some, x)).alias("at"), x.alias("label")))


def mode_vote(panel: DataFrame) -> DataFrame:
    """mv_label, votes, voters, agreement. Without any ballot the label is empty and votes counts the empty ballots."""
    found = ballots(panel, lambda c: F.lower(squeeze(c))).withColumn("best", F.array_max(_votes(F.col("ballots"))))
    label = F.coalesce(F.col("best.label"), F.lit(""))
    voters = F.size(F.filter("ballots", lambda x: x != "")).cast("long")
    return found.select(
        "id", label.alias("mv_label"), F.size(F.filter("ballots", lambda x: x == label)).cast("long").alias("votes"), voters.alias("voters"),
        F.when(voters > 0, rounded(F.col("best.n").cast("double") / voters, 4)).otherwise(0.0).alias("agreement"),
    )


def medoid_vote(panel: DataFrame) -> DataFrame:
    """As `mode_vote` for free text: without two equal ballots, the one most like the others wins."""
    found = ballots(panel).withColumn("some", F.filter("ballots", lambda x: x != "")).withColumn("best", F.array_max(_votes(F.col("ballots"))))
    n = F.size("some")
    plain = F.coalesce(F.col("best.n"), F.lit(0)) != 1
    few = found.filter(plain | (n < 2)).withColumns({"label": F.coalesce(F.col("best.label"), F.lit("")), "agreement": F.when(n > 0, F.col("best.n") / n).otherwise(0.0)})
    many = spread(found.filter(~plain & (n >= 2)), "id").withColumn("ratios", ordered_ratios("some"))
    sums = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.aggregate(F.slice("ratios", i * (n - 1) + 1, n - 1), F.lit(0.0), lambda a, b: a + b).alias("sum"), (-i).alias("at")))
    many = many.withColumn("top", F.array_max(sums)).withColumns({"label": F.get("some", -F.col("top.at")), "agreement": F.col("top.sum") / (n - 1)}).drop("ratios", "top")
    both = few.unionByName(many)
    return both.select(
        "id", F.col("label").alias("mv_label"), F.size(F.filter("ballots", lambda x: x == F.col("label"))).cast("long").alias("votes"),
        F.size("some").cast("long").alias("voters"), rounded(F.col("agreement"), 4).alias("agreement"),
    )


def label_disagreement(panel: DataFrame) -> DataFrame:
    """id, discrimination: 1 minus the largest label's share; 0 for fewer than two labels."""
    found = ballots(panel, lambda c: F.lower(squeeze(c))).withColumn("some", F.filter("ballots", lambda x: x != ""))
    top = F.array_max(_votes(F.col("ballots")))["n"]
    return found.select("id", F.when(F.size("some") >= 2, rounded(1.0 - top / F.size("some"), 6)).otherwise(0.0).alias("discrimination"))


def text_disagreement(panel: DataFrame) -> DataFrame:
    """id, discrimination: the mean over pairs of 1 minus the matching ratio of the earlier text against the later."""
    found = ballots(panel, lambda c: F.lower(squeeze(c))).select("id", F.filter("ballots", lambda x: x != "").alias("some"))
    found = spread(found, "id").withColumn("ratios", later_ratios("some"))
    n = F.size("some")
    score = F.aggregate("ratios", F.lit(0.0), lambda a, r: a + (1.0 - r)) / (n * (n - 1) / 2)
    return found.select("id", F.when(n >= 2, rounded(score, 6)).otherwise(0.0).alias("discrimination"))


def _numbered(scores: DataFrame, value: Column | None = None) -> DataFrame:
    """rank by discrimination, then id, and before: the sum of ``value`` over all rows ranked earlier.

    Rows are sorted over the cluster by range, numbered within their part, and shifted by the parts before: one row a part meets in one task.
    """
    value = F.lit(0) if value is None else value
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scores.withColumn("_value", value).repartitionByRange(parts, F.desc("discrimination"), "id").withColumn("_part", F.spark_partition_id())
    in_part = W.partitionBy("_part").orderBy(F.desc("discrimination"), "id")
    rows = written(rows.withColumns({"_place": F.row_number().over(in_part), "_within": F.coalesce(F.sum("_value").over(in_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("v"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "v")])
    placed = rows.join(F.broadcast(starts), "_part")  # one row a part
    return placed.withColumns({"rank": (F.col("_n") + F.col("_place")).cast("long"), "before": F.col("_v") + F.col("_within")}).drop("_part", "_place", "_within", "_n", "_v", "_value")


def ranked(scores: DataFrame) -> DataFrame:
    """rank by discrimination, then id."""
    return _numbered(scores).drop("before")


def top_ids(scores: DataFrame, k: int) -> DataFrame:
    """The ids with the k highest scores."""
    return scores.orderBy(F.desc("discrimination"), "id").limit(max(k, 0)).select("id")


def coverage_curve(scores: DataFrame) -> DataFrame:
    """rank and the share of all discrimination that the samples up to there hold."""
    micro = F.round(F.col("discrimination") * 1_000_000).cast("long")
    total = scores.agg(F.coalesce(F.sum(micro), F.lit(0)).alias("total"))
    numbered = _numbered(scores, micro).crossJoin(F.broadcast(total))  # one row
    return numbered.select("rank", "id", ((F.col("before") + micro) / F.when(F.col("total") == 0, 1).otherwise(F.col("total"))).alias("coverage"))
