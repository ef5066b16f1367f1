"""Importance resampling towards a target distribution, by hashed n-gram counts over an integer word dictionary.

Words are runs of letters and digits, A-Z lower-cased; features are all runs of one and two consecutive words. A block of
documents gets a dictionary from its different words to integer ids, so an n-gram is a tuple of ids (a pair packed into one
integer). Each different tuple of the block is turned back into bytes and hashed once, and the hashes are joined back to
all its occurrences. A dictionary lives as long as its block, which keeps memory bounded whatever the vocabulary, and lets no word
cross the network: only counts of buckets do. Documents keep the buckets of their features, packed, so that
hashing is not done again when the gains are known.

The gain of a bucket compares its share in the target with its share in the documents. A document's weight is the mean
gain of its features; Gumbel noise, a function of seed and doc_id alone, makes the highest scores a draw without
replacement. Scores are ranked by range partitions and their sizes, so no task sees all rows.

Defined results: null and empty texts have no features, weight 0, and are never drawn where at least one word is asked
for; a null doc_id is hashed as an empty text; rows that repeat an id are scored each for themselves, share their noise, and tie in any order;
an empty table gives an empty table; with an empty target all gains come from the counts of the documents. Other columns of the input are not
returned, so their names cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import cut, scratch_path, small_batches, spread, text_of

BUCKETS = 10_000
#: Bytes of text that share a dictionary at most; a longer text has its own.
BLOCK = 1 << 22
#: Bytes to what words are made of: A-Z to a-z, digits, a-z and all bytes from 128 on (other letters in UTF-8) to themselves, the rest to spaces.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def block_buckets(texts: list[list[bytes]], buckets: int = BUCKETS) -> list[np.ndarray]:
    """The buckets of each text's words and then of its pairs of words, in order."""
    flat = [w for words in texts for w in words]
    if not flat:
        return [np.empty(0, np.uint32) for _ in texts]
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    n = len(vocabulary)
    ones = np.array([zlib.crc32(w) % buckets for w in vocabulary], np.uint32)[ids]
    ends = np.cumsum([len(words) for words in texts])
    pairs, place = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)  # those across two texts are hashed too, and never read
    first, second = (pairs // n).tolist(), (pairs % n).tolist()
    hashed = np.array([zlib.crc32(b"%b %b" % (vocabulary[a], vocabulary[b])) % buckets for a, b in zip(first, second, strict=True)], np.uint32)
    twos = hashed[place]
    starts = ends - [len(words) for words in texts]
    return [np.concatenate([ones[a:b], twos[a : max(a, b - 1)]]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def feature_buckets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and packed (the features' buckets, 32 bits each) of each row."""
    small_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                held, size, first = [], 0, at
                while at < len(batch) and (not held or size < BLOCK):
                    t = texts[at].as_py()
                    held.append(words_of(t))
                    size += len(t)
                    at += 1
                found = block_buckets(held, buckets)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, at - first), pa.array(map(len, held), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())],
                    ["doc_id", "n_words", "n_features", "packed"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, packed binary")


def bucket_counts(features: DataFrame) -> DataFrame:
    """bucket, n over all features; each task counts its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                new = np.bincount(np.frombuffer(x.as_py(), "<u4"), minlength=len(count))
                if len(new) > len(count):
                    count = np.pad(count, (0, len(new) - len(count)))
                count += new
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], ["bucket", "n"])

    return features.select("packed").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths, from tables bucket, n; the result has ``buckets`` numbers, however large the corpus."""
    sides = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = np.zeros((2, buckets))
    for row in sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        counts[:, row["bucket"]] = row["s"], row["t"]
    (s, t), (all_s, all_t) = counts, counts.sum(1)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def mean_gain(packed: Column, gains: np.ndarray) -> Column:
    """The floored mean of the features' gains, 0 without features."""

    @F.arrow_udf("bigint")
    def of(batch: pa.Array) -> pa.Array:
        found = (gains[np.frombuffer(x.as_py(), "<u4")] for x in batch)
        return pa.array([int(x.sum()) // len(x) if len(x) else 0 for x in found], pa.int64())

    return of(packed)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths, from the hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (written already) with their rank (1, 2, 3 ...) in the given order, numbered by range partitions; equal rows are dealt over several."""
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartitionByRange(parts, *order, F.col("tie")).sortWithinPartitions(*order, "tie")
    at = cut(placed.withColumn("at", F.monotonically_increasing_id()).drop("tie"))  # partition in the upper 31 bits, row in the lower 33
    part = F.shiftright("at", 33)
    sizes = {row["part"]: row["n"] for row in at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    starts, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), (part + 1).cast("int"))
    return at.withColumn("rank", start + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at")


def importance_scores(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs``, for a draw towards the texts of ``target`` (column ``text``)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "features")
    feature_buckets(docs, text, doc_id, buckets).write.parquet(path)
    features = spark.read.parquet(path)
    wanted = feature_buckets(spread(target.select(F.lit(0).alias("doc_id"), F.col("text"))), buckets=buckets)
    gains = bucket_gains(bucket_counts(features), bucket_counts(wanted), buckets)
    weighed = features.select("doc_id", "n_words", "n_features", mean_gain(F.col("packed"), gains).alias("weight"))
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """`importance_scores` with the rank of each drawn row: of those with ``min_words`` words, the ``percent`` with the highest scores, ties to the smaller doc_id. Null where not drawn."""
    scored = cut(importance_scores(docs, target, text, doc_id, seed, buckets))
    long = F.col("n_words") >= min_words
    drawn = percent * scored.filter(long).count() // 100
    placed = ranked(scored.filter(long), F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.filter(~long).withColumn("rank", F.lit(None).cast("long")))
