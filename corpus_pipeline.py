"""A corpus pipeline of five stages, each of which keeps the columns of ``documents`` and hands on the rows it keeps.

Toxic documents go; of equal texts one stays; of near duplicates (five-word shingles, similarity 0.8) one stays;
documents that hold a benchmark item go; the rest is encoded and decoded. `run` writes each stage as Parquet in the
shared folder and reads it again, so that a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm import bpe
from quorumlens.llm.common import scratch_path
from quorumlens.llm.decontaminate import decontaminate
from quorumlens.llm.exact_dedup import exact_dedup
from quorumlens.llm.queries import vocabulary
from quorumlens.llm.simhash import near_dedup
from quorumlens.llm.toxicity import fit_toxicity, toxicity_score
from quorumlens.session import table

#: Scores from here on are toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels; a document without text stays."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return docs.filter(toxicity_score(docs, model) < TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays, one without doc_id only where the group has no other."""
    return near_dedup(docs, shingle=5, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text")), whole=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed) and whether decoding gives the text back."""
    path = vocabulary("byte_bpe_50k.json")
    both = docs.select("doc_id", "text", bpe.round_trip(F.col("text"), path).alias("both")).select("doc_id", "text", "both.*")
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding", encode),
]

#: Learned scores, fingerprints and merges are not expressible in SQL; tests/llm holds the stages' operators against plain Python or planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
