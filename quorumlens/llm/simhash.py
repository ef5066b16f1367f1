"""SimHash fingerprints, and near duplicates among them by multi-index hashing.

Fingerprints: words are separated by white space; A-Z are lower-cased; each run of ``shingle`` words,
space-joined, repeats included, is hashed by XXH64; a bit is set if over half of the hashes have it set. A
text of fewer words is one shingle, a text without words has fingerprint zero.

`hamming_components` links fingerprints at ``max_bits`` or fewer differing bits, without loss. A fingerprint
is cut into two segments of 32 bits. If two fingerprints differ in at most two bits, they differ in at most one
within the first segment or agree in the second, so the probes of a fingerprint are the 33 values of
the Hamming ball around its first segment, and its second segment as it is. Probes meet the tables of all
segments in a join that verifies the complete distance. Equal fingerprints count once. A table entry with more than
``bucket`` fingerprints (many fingerprints of one neighbourhood) would pair within itself; its fingerprints and
those that probe it take the other exact way: two fingerprints at most two bits apart share a value in
their balls of one bit, so each is joined to the smallest fingerprint of every such value, 65 rows a fingerprint
and at most 65 fingerprints a value.

`near_duplicate_groups` is for similarities a 64-bit radius of two cannot reach. It has two fingerprints: an index of 192
bits over pairs of words, which scattered edits change least, and one of 512 bits over five words. The
index has six segments of 32 bits, and a ball of one bit on the probing and on the stored side, so that segments two
bits apart meet. All members of a bucket are compared in the second fingerprint's complete distance; buckets of any size are
cut into tiles that meet two at a time, and give fewer links than they have members. The distance bound stands for the
Jaccard similarity over five words, three standard deviations wide of it, so these links only say which texts belong to one candidate
group. Within each group the texts' sets of shingles are compared, again in tiles: a link is a Jaccard similarity of ``similarity`` or more, exactly.

Defined results: null and blank texts have fingerprint zero and are linked like any other; repeated rows share
a component; a null doc_id never names a component, and groups without any other id have none. Rows are told apart by doc_id and text, so
different texts under one doc_id, and rows without doc_id, have groups of their own. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.llm.common import by_slices, cut, free_name, salted_join, sent_if_few, spread, text_of
from quorumlens.llm.components import connected_components

SEED = 42
#: Words a shingle and 64-bit parts of the index of `near_duplicate_groups`, and parts that verify.
INDEX_SHINGLE, INDEX_LONGS, LONGS = 2, 3, 8
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 13


def split(text: str) -> list[bytes]:
    """The words, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every shingle, in order."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    return np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash made of the first (k = 0: the first), by the splitmix64 finaliser."""
    if k == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray, longs: int) -> list[int]:
    """Signed 64-bit parts of the fingerprint of shingles' hashes."""
    count = np.zeros(64 * longs, np.int64)
    for at in range(0, len(h), BLOCK):
        some = np.stack([mixed(h[at : at + BLOCK], k) for k in range(longs)], 1).astype("<u8")
        count += np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(h), bitorder="little").view("<i8").tolist()


def fingerprint(text: str, shingle: int, longs: int = 1) -> list[int]:
    """Signed 64-bit parts of a text's fingerprint."""
    return majority(shingle_hashes(split(text), shingle), longs)


def fingerprints(text: Column, *kinds: tuple[int, int]) -> Column:
    """array<bigint>: the parts of each of ``kinds`` (words a shingle, parts), one after the other."""

    def of(text: str) -> list[int]:
        words = split(text)
        return [part for shingle, longs in kinds for part in majority(shingle_hashes(words, shingle), longs)]

    return by_slices("array<bigint>", pa.list_(pa.int64()), lambda: lambda texts: list(map(of, texts)), text_of(text))


def segment(part: Column, i: int) -> Column:
    """The i-th segment of 32 bits of a 64-bit part."""
    return F.shiftright(part, 32).cast("long").bitwiseAND(0xFFFFFFFF) if i else part.bitwiseAND(0xFFFFFFFF)


def ball(value: Column, bits: int, radius: int) -> Column:
    """The values within ``radius`` (0 or 1) bits, as an array."""
    masks = [0] + [m - (1 << 64) if (m := 1 << i) >= 1 << 63 else m for i in range(bits)] * radius
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def hamming_links(prints: DataFrame, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """a, b: pairs of the distinct fingerprints ``prints.fp`` whose links have the same components as all pairs within ``max_bits``."""
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    per, rest = divmod(max_bits, 2)
    radii = [per if i <= rest else per - 1 for i in (0, 1)]  # of the segments' balls; below 0: no probe
    key = lambda i, values: F.transform(values, _plus(i << 32))
    stored = prints.select("fp", F.explode_outer(F.concat(*[key(i, F.array(segment(F.col("fp"), i))) for i in (0, 1)])).alias("key"))
    probes = prints.select("fp", F.explode_outer(F.concat(*[key(i, ball(segment(F.col("fp"), i), 32, r)) for i, r in enumerate(radii) if r >= 0])).alias("key"))
    full = cut(stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("key"))
    crowded = not full.isEmpty()
    near = prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if crowded:
        dense = probes.join(full, "key", "left_semi").select("fp").unionByName(stored.join(full, "key", "left_semi").select("fp")).distinct()
        balls = dense.select("fp", F.explode_outer(ball(F.col("fp"), 64, 1)).alias("value"))
        if max_bits == 2:
            near = balls.groupBy("value").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1").select(F.array_min("fps").alias("a"), F.explode_outer("fps").alias("b"))
        elif max_bits == 1:
            near = balls.join(dense.select(F.col("fp").alias("value")), "value").select(F.col("fp").alias("a"), F.col("value").alias("b"))
        near = near.filter("a <> b")
        stored, probes = stored.join(full, "key", "left_anti"), probes.join(full, "key", "left_anti")
    a, b = probes.select("key", F.col("fp").alias("a")), stored.select("key", F.col("fp").alias("b"))
    within = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    links = a.join(b, "key").filter(within).select("a", "b")
    return links.unionByName(near) if crowded else links


def hamming_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id (smallest doc_id reachable) of each row."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), (shingle, 1))[0].alias("fp")))
    prints = cut(spread(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "fp"))
    parts = connected_components(hamming_links(prints.select("fp"), max_bits, bucket)).withColumnRenamed("node", "fp")
    placed = prints.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = placed.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    named = salted_join(placed, cut(names), ["component"], "prints", "fp").select("fp", "n", "component_id")
    return salted_join(rows, cut(named), ["fp"], "n", "doc_id").select("doc_id", "fp", "component_id")


def distance_bound(similarity: float, bits: int = 192, deviations: float = 0.0) -> int:
    """The distance at a Jaccard similarity, for texts of like length: cosine c = 2J / (1 + J), an angle of acos(c) in bits * angle / pi, and so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets, given as arrays without repeats; two empty ones are equal."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def linked_within(bound: int, similarity: float | None = None):
    """For mapInArrow over rows (key, lo, hi, tile, id, f0 ...) sorted by key, lo, hi: a, b for enough near pairs of each (key, lo, hi) to hold its components together.

    similarity: of the pairs within the bound, only those count whose sets (column hashes, sorted) have this Jaccard similarity.

    Rows are compared at growing offsets, all buckets of a batch at once. Rows that are linked already are not compared again, and a
    component is put out as links to its first row, so that a bucket of n rows gives fewer than n. Where lo and hi
    differ, rows of the same tile meet in another bucket.
    """

    def near(t: pa.Table) -> pa.Table:
        key, lo, hi, tile = (t[c].to_numpy() for c in ("key", "lo", "hi", "tile"))
        parts = [t[c].to_numpy() for c in t.column_names if re.fullmatch(r"f\d+", c)]
        if similarity is not None:
            flat, ends = t["hashes"].combine_chunks(), np.append(0, np.cumsum(pc.list_value_length(t["hashes"]).to_numpy()))
            flat = flat.flatten().to_numpy()
        start = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
        across = lo != hi
        label = np.arange(len(key))
        at = label[:-1]
        d = 1
        while len(at := at[start[at] == start[np.minimum(at + d, len(key) - 1)]]):
            some = at[(label[at] != label[at + d]) & ~(across[at] & (tile[at] == tile[at + d]))]
            away = np.zeros(len(some), np.int64)
            for f in parts:
                away += np.bitwise_count((f[some] ^ f[some + d]).view(np.uint64))
            a = some[away <= bound]
            if similarity is not None and len(a):
                a = a[[jaccard(flat[ends[i] : ends[i + 1]], flat[ends[i + d] : ends[i + d + 1]]) >= similarity for i in a.tolist()]]
            b = a + d
            while len(a):  # of several links of a label, the lowest counts first
                x, y = label[a], label[b]
                root = np.arange(len(label))
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
                label = root[label]
                differ = label[a] != label[b]
                a, b = a[differ], b[differ]
            d += 1
            at = at[at + d < len(key)]
        ids, rest = t["id"].to_numpy(), np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": ids[rest], "b": ids[label[rest]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            k = [t[c].to_numpy() for c in ("key", "lo", "hi")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            if len(cuts):  # the last bucket may go on in the next batch
                yield from near(t.slice(0, int(cuts[-1]))).to_batches()
                held = t.slice(int(cuts[-1])).to_batches()
        if held:
            yield from near(pa.Table.from_batches(held)).to_batches()

    return run


def crowded_keys(prints: DataFrame, parts: Sequence[str], tile: int) -> DataFrame:
    """key, n of the buckets with more than ``tile`` members, without making any bucket.

    A bucket is the 33 segment values around its key, so one with more members has a value that ``tile`` / 33 fingerprints share;
    only the balls around such values are looked at.
    """
    stored = F.array(*[segment(F.col(parts[i // 2]), i % 2) + F.lit(i << 32) for i in range(2 * len(parts))])
    values = cut(prints.select(F.explode(stored).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    keys = values.filter(F.col("n") * 33 > tile).select(F.explode(ball(F.col("value"), 32, 1)).alias("key")).distinct()
    members = keys.select("key", F.explode(ball(F.col("key"), 32, 1)).alias("value")).join(values, "value")
    # values of one fingerprint each are not counted above: at most 33 a key, so they can't be what fills it
    return members.groupBy("key").agg(F.sum("n").alias("n")).withColumn("n", F.col("n") + 33).filter(F.col("n") > tile)


def near_links(prints: DataFrame, bound: int, tile: int = 4096, index: Sequence[str] = ()) -> DataFrame:
    """a, b: links of ``prints`` (id, f0, f1, ...) with the same components as all pairs that share a bucket and differ in at most ``bound`` bits of f0, f1, ....

    ``index``: the columns whose segments make the buckets, f0, f1, ... where it is empty. Buckets of one member go at once. Larger ones
    than ``tile`` are cut into tiles by a hash of the id, and each two tiles meet in a group of their own: a task holds two
    tiles, whatever the size of the bucket, and no pair is left out. The rows of such a bucket go to its tiles at once and never meet before.
    """
    parts = list(index) or [c for c in prints.columns if c != "id"]
    balls = [F.transform(ball(segment(F.col(parts[i // 2]), i % 2), 32, 1), _plus(i << 32)) for i in range(2 * len(parts))]
    keyed = prints.select("id", F.explode_outer(F.concat(*balls)).alias("key"))
    crowded = cut(crowded_keys(prints, parts, tile))
    count = F.count(F.lit(1)).over(W.partitionBy("key"))
    if crowded.isEmpty():
        shared = keyed.withColumn("n", count).filter("n > 1")
    else:
        crowded = sent_if_few(crowded)
        rest = keyed.join(crowded, "key", "left_anti").withColumn("n", count).filter("n > 1")
        shared = rest.unionByName(keyed.join(crowded, "key").select("id", "key", "n"))
    rows = in_tiles(cut(shared), F.ceil(F.col("n") / tile)).join(prints.drop(*index), "id")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id").mapInArrow(linked_within(bound), "a bigint, b bigint")


def in_tiles(rows: DataFrame, tiles: Column) -> DataFrame:
    """key, lo, hi, tile, id: each row of ``rows`` (key, id, ...) in every two tiles of its key that hold it."""
    dealt = rows.withColumn("tile", F.pmod(F.xxhash64("id"), tiles)).select("key", "id", "tile", F.explode_outer(F.sequence(F.lit(0).cast("long"), tiles.cast("long") - 1)).alias("other"))
    return dealt.select("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "id")


def _plus(offset: int):
    return lambda v: v + offset


def shingle_sets(text: Column, shingle: int) -> Column:
    """array<bigint>: the different hashes of a text's shingles, sorted."""
    make = lambda: lambda texts: [np.unique(shingle_hashes(split(t), shingle)).view(np.int64).tolist() for t in texts]
    return by_slices("array<bigint>", pa.list_(pa.int64()), make, text_of(text), step=100)


def similar_links(texts: DataFrame, bound: int, similarity: float, shingle: int, tile: int = 1 << 19) -> DataFrame:
    """a, b: links of ``texts`` (id, key, text, f0, f1, ...) with the same components as all pairs of a key that differ in at most ``bound`` bits and have the Jaccard similarity.

    A key is cut into tiles of about ``tile`` shingles. One text is in one task, however long.
    """
    sets = cut(texts.select("key", "id", shingle_sets(F.col("text"), shingle).alias("hashes"), *[c for c in texts.columns if c not in ("id", "key", "text")]))
    sizes = sets.groupBy("key").agg(F.sum(F.size("hashes") + 1).alias("n"), F.count(F.lit(1)).alias("members"))
    placed = salted_join(sets.select("key", "id"), cut(sizes), ["key"], "members", "id")
    rows = in_tiles(placed, F.ceil(F.col("n") / tile)).join(sets.drop("key"), "id")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    return rows.mapInArrow(linked_within(bound, similarity), "a bigint, b bigint")


def near_members(docs: DataFrame, text: str, doc_id: str, shingle: int, similarity: float) -> DataFrame:
    """doc_id, hash (of the text), component, group_id and best (whether it is the one to keep) of the rows that share a group with others; repeated rows once, with their number."""
    index, parts = [f"i{k}" for k in range(INDEX_LONGS)], [f"f{k}" for k in range(LONGS)]
    both = fingerprints(F.col(text), (INDEX_SHINGLE, INDEX_LONGS), (shingle, LONGS))
    prints = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("hash"), both.alias("p"))
    rows = cut(prints.select("doc_id", "hash", *[F.col("p")[k].alias(f) for k, f in enumerate(index + parts)]))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    distinct = rows.groupBy(*index, *parts).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = cut(spread(distinct, *index).withColumn("id", F.monotonically_increasing_id()))  # fixed once written
    bound = distance_bound(similarity, 64 * LONGS, 3.0)
    near = connected_components(near_links(distinct.select("id", *index, *parts), bound, index=index)).withColumnRenamed("node", "id")
    sources = near.join(distinct, "id").select("id", F.col("component").alias("key"), F.col("first.doc_id").alias("_id"), F.col("first.hash").alias("_hash"), *parts)
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    found = texts.join(sent_if_few(cut(sources)), same).drop("doc_id", "hash", "_id", "_hash").dropDuplicates(["id"])
    links = similar_links(found, bound, similarity, shingle)
    parts_of = connected_components(links).withColumnRenamed("node", "id")
    grouped = cut(distinct.join(parts_of, "id", "left").filter("n > 1 or component is not null").select(*index, *parts, "n", F.coalesce("component", "id").alias("component")))
    members = salted_join(rows, grouped, index + parts, "n", "hash").groupBy("doc_id", "hash", "component").agg(F.count(F.lit(1)).alias("repeats"))
    members = cut(members)
    firsts = members.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    named = salted_join(members, cut(firsts), ["component"], "rows", "hash")
    return cut(named.select("doc_id", "hash", "component", F.col("first.doc_id").alias("group_id"), (order == F.col("first")).alias("best"), "repeats"))


def _with_members(docs: DataFrame, text: str, doc_id: str, shingle: int, similarity: float, *wanted: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` with some columns of its members (under free names, given last), null where a row has no group; and the members."""
    members = near_members(docs, text, doc_id, shingle, similarity)
    names = [free_name(docs, f"member_{c}") for c in ("doc_id", "hash", *wanted)]
    side = members.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "hash", *wanted), names, strict=True)])
    same = F.col(doc_id).eqNullSafe(F.col(names[0])) & (F.xxhash64(text_of(text)) == F.col(names[1]))
    return docs.join(sent_if_few(side), same, "left"), members, names


def near_duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, name: str = "group_id") -> DataFrame:
    """``docs`` with a last column (``name``, or _``name`` where the table has one): the smallest doc_id of its group of near duplicates, its own where it has none."""
    joined, _, names = _with_members(docs, text, doc_id, shingle, similarity, "group_id", "component")
    group = F.when(F.col(names[3]).isNull(), F.col(doc_id)).otherwise(F.col(names[2]))
    return joined.withColumn(free_name(docs, name), group).drop(*names)


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows that stay, with their columns: of each group of near duplicates the one with the smallest doc_id (null last; then by a hash of the text), once."""
    joined, members, names = _with_members(docs, text, doc_id, shingle, similarity, "best", "repeats")
    kept = joined.filter(F.coalesce(F.col(names[2]), F.lit(True)))
    if not members.filter("best and repeats > 1").isEmpty():
        repeated = F.coalesce(F.col(names[3]) > 1, F.lit(False))
        kept = kept.filter(~repeated).unionByName(kept.filter(repeated).dropDuplicates([names[0], names[1]]))
    return kept.drop(*names)
