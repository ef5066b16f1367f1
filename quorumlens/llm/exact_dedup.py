"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Equal texts are found in three steps, each of which compares digest *and* full text (both are
grouping keys), so a digest collision never merges two texts:

1. every task combines the equal texts it has read (the map side of the first aggregation);
2. the rows of a digest are spread over ``salts`` groups and combined there;
3. the salt winners, at most ``salts`` for each distinct text, are combined globally.

A text that makes up a third of all rows therefore never meets in one task before it is down to
``salts`` rows. Unsalted, only counts and winners move.

Defined results: null text counts as empty; the empty text is a text like any other; of equal texts
the largest doc_id stays, and a null doc_id loses to any other. Rows that repeat both doc_id and text
are all reported, with one of them kept; where their other columns differ, a hash of these decides which. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.llm.common import cut, free_name, text_of


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def staged_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 32, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row for each distinct text: digest, text, keep_id (the largest doc_id), group_size."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("digest", digest(F.col("text")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    merged = salted.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return merged.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def duplicate_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 32, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """For each row of ``docs``: doc_id, digest, keep_id, group_size, kept.

    Only groups of two or more travel to the rows again, by digest. Where one digest stands for several
    texts, the rows concerned are matched by their full text instead.
    """
    groups = staged_groups(docs, text, doc_id, salts, digest)
    by_digest = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = cut(by_digest.filter("group_size > 1"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("digest", digest(F.col("text")))
    found = _with_groups(rows.select("doc_id", "digest"), by_digest, salts)
    single = F.col("n_texts").isNull()
    report = found.filter(single | (F.col("n_texts") == 1)).select(
        "doc_id", "digest", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
    clash = by_digest.filter("n_texts > 1").select("digest")
    if not clash.isEmpty():
        unclear = rows.join(clash, "digest", "left_semi").join(groups, ["digest", "text"])
        report = report.unionByName(unclear.select("doc_id", "digest", "keep_id", "group_size"))
    turn = F.row_number().over(W.partitionBy("doc_id", "digest", "keep_id").orderBy("group_size"))
    return report.withColumn("turn", turn).select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept")
    )


def _with_groups(rows: DataFrame, groups: DataFrame, salts: int, crowd: int = 1000) -> DataFrame:
    """rows with n_texts, keep_id and group_size of their digest's group, null for digests of one row.

    Rows of groups of ``crowd`` or more are spread over the salts; the second join gives them a key of their own, so no
    digest gathers its rows in one task.
    """
    fields = ["n_texts", "keep_id", "group_size"]
    large = groups.filter(F.col("group_size") >= crowd).select("digest", F.explode_outer(F.array(*map(F.lit, range(salts)))).alias("salt"), *fields)
    small = groups.filter(F.col("group_size") < crowd).select(F.col("digest").alias("key"), *[F.col(c).alias(f"small_{c}") for c in fields])
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    first = salted.join(large, ["digest", "salt"], "left").withColumn("key", F.when(F.col("n_texts").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "digest", "salt")))
    return first.join(small, "key", "left").select("doc_id", "digest", *[F.coalesce(c, f"small_{c}").alias(c) for c in fields])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = 32) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts (null counts as empty) the one with the largest doc_id."""
    digest, whole, salt, best = (free_name(docs, x) for x in ("digest", "whole_text", "salt", "best"))
    rows = docs.select(
        sha256_hex(text_of(text)).alias(digest), text_of(text).alias(whole), F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int").alias(salt),
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias(best), F.col(text).isNull().alias("was_null")
    )
    plain = [f.name for f in docs.schema if f.name != text and "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(best)[doc_id], ~F.col("was_null"), F.xxhash64(*[F.col(best)[c] for c in plain]))
    pick = [F.max_by(best, order).alias(best), F.max_by("was_null", order).alias("was_null")]
    merged = rows.groupBy(digest, whole, salt).agg(*pick)
    winners = merged.groupBy(digest, whole).agg(*pick)
    back = {c: (F.when(~F.col("was_null"), F.col(whole)) if c == text else F.col(best)[c]) for c in docs.columns}
    return winners.select(*[v.alias(c) for c, v in back.items()])
