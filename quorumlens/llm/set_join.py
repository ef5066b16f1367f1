"""Documents linked by the Jaccard similarity of their shingle sets: a size-aware heavy-light join, exact.

A document's set holds its different runs of ``shingle`` words (A-Z lower-cased, words separated by ASCII white space). Two sets of n and m shingles link
when they share need(n, m) or more of them. Equal sets are one node.

Light sets are joined by subsets: sets of n and m shingles link exactly when they share a subset of need(n, m) shingles, so each light set enumerates its
subsets of that size, for each partner size m that the similarity allows, and equal subsets meet in a grouping; all that meet
are linked, so each is linked to the group's first set, and no pairs are made.

Heavy sets are joined by inverted lists. Shingles have one global order, rarest first; two linked sets share one of the first n - need + 1 shingles of both,
so only those are listed, and shingles that no other document has count but need no list: a set with more than that of them has no partner. Where two sets
meet in a list, the places of the shingle in both bound what they can share from there on, which rules most pairs out
unseen. Lists are scanned twice. First every set meets only the head of its list, the set with the smallest share of rare shingles, a number of pairs linear in the
lists; verified links make components. Then, in the lists that still hold several components, each set outside the list's largest
component meets the others' members. Links inside a component can't change the result, so a large group of near copies costs what its lists
hold, not their square; what is quadratic is only sets that fit each other in the bound, share rare shingles, and still are not linked.

The boundary between light and heavy is where the subsets of all smaller sets, and the shingles that larger sets send and list, are fewest, by the corpus' counts of each
size. A light set near the boundary can have a heavy partner, so it is listed too; smaller ones are not sent at all. Subsets of sets
above ``MOST_LIGHT`` shingles always cost more.

The order needs every shingle's number of documents. A block of documents sends the shingles of each hash range as one packed row; the
range's task counts them and sends back those that occur more than once, with the logarithm of their number. Rows per shingle would take
several times the network and disk. Of a shingle that many documents of a block hold, only the number is sent, so a range gets a few entries a block of the most
frequent one.

Defined results: null or blank texts have an empty set and are linked with nothing, not even each other; fewer words than a shingle are one shingle; repeated rows and equal texts
are one component; a null doc_id never names a component unless the component has no other, and an empty set's component is its own doc_id; an empty table gives an empty one.
Other columns of the input are not returned, so their names cannot clash. Shingles are compared by 64-bit and sets by 128-bit hashes. ``docs`` is read several times and in blocks, so give a table that reads the same each time (files, or a checkpoint).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import FEW, by_slices, cut, salted_join, sent_if_few, small_batches, text_of
from quorumlens.llm.components import connected_components
from quorumlens.llm.simhash import shingle_hashes, split

#: Largest size whose subsets may be enumerated (a set of 20 has about 2,900 of them).
MOST_LIGHT = 20
#: Shingles of a block of documents, and of a hash range.
BLOCK, RANGE = 1 << 19, 1 << 20
#: Documents of a block beyond which a shingle is sent once, with their number instead of theirs.
FREQUENT = 8
#: What marks such a number among documents' numbers; a block has fewer documents.
MARK = 1 << 15
#: Lists from this length on are met in tiles of so many sets.
TILE = 2000


def need(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_rows(n: int, percent: int) -> int:
    """Subsets that a set of n shingles enumerates."""
    return sum(math.comb(n, need(n, m, percent)) for m in partner_sizes(n, percent))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(split(text), shingle))


def set_name(hashes: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def named_sets(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """row (a number), doc_id, hash (of the text), n and node (the set's name) of each row."""
    arrow = pa.struct([("n", pa.int64()), ("node", pa.binary())])

    def of(texts: list[str]) -> list[dict]:
        sets = [shingle_set(t, shingle) for t in texts]
        return [{"n": len(s), "node": set_name(s)} for s in sets]

    both = by_slices("struct<n: bigint, node: binary>", arrow, lambda: of, text_of(text), step=100)
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("hash"), both.alias("s")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "hash", "s.*")


def set_nodes(rows: DataFrame) -> DataFrame:
    """id (a number, fixed once written), node, n, copies (rows that have it), first_id (their smallest doc_id) and one (a row that has it) of each set that is not empty."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")))
    nodes = rows.filter("n > 0").groupBy("node").agg(one.alias("one"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    return cut(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "n", "copies", F.col("one._id").alias("first_id"), "one"))


#: Ranges up to which a shingle is sent by its lower 48 bits; its range is the upper part of its name then.
NARROW = 1 << 15


def placed(shingles: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each shingle and its name: the range and the lower 48 bits while there are few ranges, else the shingle itself. Two shingles of one name only make a candidate that is verified."""
    part = (shingles >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16) if ranges < NARROW else (shingles >> np.uint64(20)) % np.uint64(ranges)
    return part, part << np.uint64(48) | shingles & np.uint64((1 << 48) - 1) if ranges < NARROW else shingles


def to_bytes(names: np.ndarray, ranges: int) -> bytes:
    raw = names.astype("<u8")
    return np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() if ranges < NARROW else raw.tobytes()


def from_bytes(data: bytes, part: int, ranges: int) -> np.ndarray:
    if ranges >= NARROW:
        return np.frombuffer(data, "<u8")
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8")[:, 0] | np.uint64(part) << np.uint64(48)


PACKED = "range int, block long, shingles binary, docs binary, heads binary, hot binary"


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in PACKED.split(", ")])


def block_rows(sets: list[np.ndarray], block: int, ranges: int) -> Iterator[tuple]:
    """Rows of `PACKED` of a block of documents: shingles (names) and docs (16 bits: a document's number in the block, or `MARK` plus how many there are of a frequent shingle)
    by range; and one row without shingles, with heads (each document's name and size) and the frequent shingles and documents (hot, docs)."""
    every, doc = placed(np.concatenate(sets), ranges)[1], np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    different, place, n = np.unique(every, return_inverse=True, return_counts=True)
    often = n > FREQUENT
    hot = often[place]
    shingles, docs = np.append(every[~hot], different[often]), np.append(doc[~hot], MARK + n[often]).astype("<u2")
    part = shingles >> np.uint64(48) if ranges < NARROW else placed(shingles, ranges)[0]
    order = np.argsort(part, kind="stable")
    shingles, docs, part = shingles[order], docs[order], part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), block, to_bytes(shingles[a:b], ranges), docs[a:b].tobytes(), None, None
    heads = b"".join(set_name(s) + len(s).to_bytes(8, "little") for s in sets)
    yield block % ranges, block, None, doc[hot].astype("<u2").tobytes(), heads, every[hot].astype("<u8").tobytes()


def blocks_by_range(docs: DataFrame, text: str, shingle: int, ranges: int, least: int) -> DataFrame:
    """`block_rows` of blocks of the sets of ``docs`` that have at least ``least`` shingles."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size, seen = [], 0, set()
        for batch in batches:
            for t in batch.column(0):
                s = shingle_set(t.as_py(), shingle)
                if len(s) >= max(1, least) and (name := set_name(s)) not in seen:  # equal sets of a block count once
                    seen.add(name)
                    held.append(s)
                    size += len(s)
                if size >= BLOCK or len(held) == MARK - 1:
                    yield packed(list(block_rows(held, block, ranges)))
                    block += 1
                    held, size, seen = [], 0, set()
        if held:
            yield packed(list(block_rows(held, block, ranges)))

    small_batches()
    return docs.select(text_of(text)).mapInArrow(run, PACKED)


def shared_shingles(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Over `block_rows` sorted by range: the same rows with the shingles of two or more documents only; heads are a byte a shingle, four times the logarithm of its number."""

    def counted(rows: list[tuple]) -> Iterator[tuple]:
        shingles, docs = [from_bytes(r[2], r[0], ranges) for r in rows], [np.frombuffer(r[3], "<u2") for r in rows]
        _, place = np.unique(np.concatenate(shingles), return_inverse=True)
        some = np.concatenate(docs).astype(np.int64)
        n = np.bincount(place, np.where(some >= MARK, some - MARK, 1))
        level = np.minimum(4 * np.log2(n), 255).astype(np.uint8)[place]
        at = 0
        for row, mine, whose in zip(rows, shingles, docs, strict=True):
            levels = level[at : at + len(mine)]
            at += len(mine)
            if (some := levels > 0).any():
                yield *row[:2], to_bytes(mine[some], ranges), whose[some].tobytes(), levels[some].tobytes(), None

    held: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
            if row[2] is None:
                out.append(row)
                continue
            if held and held[0][0] != row[0]:
                out += counted(held)
                held = []
            held.append(row)
        if out:
            yield packed(out)
    if held and (out := list(counted(held))):
        yield packed(out)


def rare_prefixes(percent: int, ranges: int):
    """For mapInArrow over `shared_shingles` sorted by block: shingle, node, n, left (shingles of the set from this one on, in the global order) of the inverted lists, and level."""

    def entries(rows: list[tuple]) -> pa.RecordBatch:
        head = next(r for r in rows if r[2] is None)
        names = [head[4][k : k + 16] for k in range(0, len(head[4]), 24)]
        sizes = np.array([int.from_bytes(head[4][k + 16 : k + 24], "little") for k in range(0, len(head[4]), 24)], np.int64)
        shared = [r for r in rows if r[2] is not None]
        column = lambda k, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(r[k], kind) for r in shared]])
        shingles = np.concatenate([np.empty(0, np.uint64), *[from_bytes(r[2], r[0], ranges) for r in shared]])
        docs, levels = column(3, "<u2").astype(np.int64), column(4, np.uint8)
        hot, whose = np.frombuffer(head[5], "<u8"), np.frombuffer(head[3], "<u2").astype(np.int64)
        marked = docs >= MARK
        frequent = np.argsort(shingles[marked])  # all frequent shingles came back
        at = np.searchsorted(shingles[marked], hot, sorter=frequent)
        of_hot = levels[marked][frequent][at]
        shingles, docs, levels = np.append(shingles[~marked], hot), np.append(docs[~marked], whose), np.append(levels[~marked], of_hot)
        order = np.lexsort((shingles, levels, docs))
        shingles, docs, levels = shingles[order], docs[order], levels[order]
        n, have = sizes[docs], np.bincount(docs, minlength=len(sizes))
        place = n - have[docs] + np.arange(len(docs)) - (np.cumsum(have) - have)[docs]  # shingles of no other document come first
        some = place < n + percent * -n // 100 + 1  # all but the fewest that it shares with any partner, and one
        arrays = [pa.array(shingles[some].view(np.int64), pa.int64()), pa.array([names[d] for d in docs[some].tolist()], pa.binary()), pa.array(n[some], pa.int64()), pa.array((n - place)[some], pa.int64())]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(levels[some].astype(np.int32), pa.int32())], ["shingle", "node", "n", "left", "level"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if held and held[0][1] != row[1]:
                    yield entries(held)
                    held = []
                held.append(row)
        if held:
            yield entries(held)

    return run


LISTED = "shingle long, node binary, n long, left long, level int"


def inverted_lists(docs: DataFrame, text: str, shingle: int, percent: int, shingles: int, least: int = 1) -> DataFrame:
    """shingle, node, n, left, level: the lists of the rarest shingles of each set of at least ``least``, without those of one document only. shingles: how many there are in all."""
    ranges = max(1, -(-shingles // RANGE))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    up = blocks_by_range(docs, text, shingle, ranges, least).repartition(max(parts, ranges), "range").sortWithinPartitions("range")
    down = up.mapInArrow(lambda batches: shared_shingles(batches, ranges), PACKED).repartition(parts, "block").sortWithinPartitions("block")
    return down.mapInArrow(rare_prefixes(percent, ranges), LISTED).dropDuplicates(["shingle", "node"])


def light_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest size of light sets: the rows of subsets up to it, and the shingles that are sent and listed beyond it, are fewest. sizes: how many sets of each size, up to `MOST_LIGHT`."""

    def cost(bound: int) -> int:
        light = sum(sets * subset_rows(n, percent) for n, sets in sizes.items() if n <= bound)
        return light + sum(sets * (n + n - -(-percent * n // 100) + 1) for n, sets in sizes.items() if n >= least_listed(bound, percent))

    return min(range(MOST_LIGHT, -1, -1), key=cost)


def least_listed(light: int, percent: int) -> int:
    """The smallest size that a partner of a heavy set can have."""
    return -(-percent * (light + 1) // 100)


def subsets(sets: DataFrame, percent: int) -> DataFrame:
    """id, n, low, high (sizes that meet), name (of a subset of need(low, high) shingles) of each light set (id, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, raw in zip(batch.column(0), batch.column(1), strict=True):
                id_, hashes = id_.as_py(), np.frombuffer(raw.as_py(), "<u8")
                n, rows = len(hashes), []
                for m in partner_sizes(n, percent):
                    low, high = min(n, m), max(n, m)
                    rows += [(id_, n, low, high, xxhash.xxh3_128_digest(b"".join(s))) for s in itertools.combinations([h.tobytes() for h in hashes], need(low, high, percent))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "n", "low", "high", "name"])

    return sets.select("id", "hashes").mapInArrow(run, "id long, n long, low long, high long, name binary")


def light_links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links of light sets with the components of all. Sets of the smaller size that share a subset link with all others of its group; without any of those, a group says nothing."""
    made = cut(subsets(sets, percent))
    groups = made.groupBy("low", "high", "name").agg(F.min(F.when(F.col("n") == F.col("low"), F.col("id"))).alias("first"), F.count(F.lit(1)).alias("rows"))
    groups = cut(groups.filter("first is not null and rows > 1"))
    return salted_join(made, groups, ["low", "high", "name"], "rows", "id").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))


def fits(x: str, y: str, percent: int) -> Column:
    """Whether two entries of a list can belong to linked sets: the sets still can share enough from this shingle on, and their sizes allow it."""
    low, high = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (F.least(f"{x}.left", f"{y}.left") * (100 + percent) >= percent * (low + high)) & (100 * low >= percent * high)


def packed_sets(docs: DataFrame, text: str, doc_id: str, shingle: int, nodes: DataFrame) -> DataFrame:
    """id, hashes (packed) of the given nodes (id, one), each made from one document."""
    wanted = cut(nodes.select("id", "one._id", "one._hash"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    found = texts.join(sent_if_few(wanted), same).select("id", "text").dropDuplicates(["id"])
    hashes = by_slices("binary", pa.binary(), lambda: lambda many: [shingle_set(t, shingle).astype("<u8").tobytes() for t in many], F.col("text"), step=100)
    return cut(found.select("id", hashes.alias("hashes")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Few pairs are sent to the sets of their first; of more, the sets of a node in many pairs are spread with its pairs."""
    pairs = cut(pairs)

    def link(left: list[bytes], right: list[bytes]) -> list[bool]:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            out.append(len(np.intersect1d(x, y, assume_unique=True)) >= need(len(x), len(y), percent))
        return out

    named = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}"))
    if pairs.limit(FEW + 1).count() <= FEW:
        both = named("a").join(F.broadcast(pairs), "a").join(named("b"), "b")
    else:
        side = lambda c: named(c).join(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("pairs")), c)
        both = salted_join(salted_join(pairs, cut(side("a")), ["a"], "pairs", "b").drop("pairs"), cut(side("b")), ["b"], "pairs", "a")
    return both.filter(by_slices("boolean", pa.bool_(), lambda: link, F.col("set_a"), F.col("set_b"), step=50)).select("a", "b")


def head_pairs(lists: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """a, b: each set of a list with the list's head."""
    met = salted_join(lists, heads, ["shingle"], "sets", "id")
    pair = met.select(F.struct("id", "n", "left").alias("x"), F.struct("head.id", "head.n", "head.left").alias("y")).filter(F.col("x.id") != F.col("y.id")).filter(fits("x", "y", percent))
    return pair.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def rest_pairs(lists: DataFrame, heads: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of each list that different components still keep apart, where one set at least is outside the list's largest component."""
    placed = salted_join(lists, heads.select("shingle", "sets"), ["shingle"], "sets", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut(placed.filter(F.col("left") * (100 + percent) >= percent * (F.col("n") + F.ceil(F.lit(percent) * F.col("n") / 100))))  # others fit no partner here
    counts = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("members"))
    main = counts.groupBy("shingle").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    main = cut(main.join(heads.select("shingle", "sets"), "shingle"))
    several = salted_join(placed.drop("sets"), main.select("shingle", "main", "sets"), ["shingle"], "sets", "id")
    tiles = F.ceil(F.col("sets") / TILE)
    x = several.filter(F.col("component") != F.col("main")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), tiles.cast("long") - 1))).alias("x")
    y = several.withColumn("tile", F.pmod(F.xxhash64("id"), tiles)).alias("y")
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.component") != F.col("y.component")) & once & fits("x", "y", percent))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of links (a, b), written already. Few links are joined in one task, more by stars (`connected_components`)."""
    if links.limit(FEW + 1).count() > FEW:
        return connected_components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "component"])

    return cut(links.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long"))


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row."""
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    rows = cut(named_sets(docs, text, doc_id, shingle))
    nodes = set_nodes(rows)
    total = rows.agg(F.sum("n")).first()[0] or 0
    light = light_boundary({r["n"]: r["sets"] for r in nodes.filter(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()}, percent)
    lists = inverted_lists(docs, text, shingle, percent, total, least_listed(light, percent))
    heavy = cut(lists.join(nodes.select("node", "id"), "node").select("shingle", "id", "n", "left"))
    head = F.max_by(F.struct("id", "n", "left"), F.struct(F.col("left") / F.col("n"), "id")).alias("head")
    heads = heavy.groupBy("shingle").agg(head, F.count(F.lit(1)).alias("sets"), F.max("n").alias("largest"))
    heads = cut(heads.filter((F.col("sets") > 1) & (F.col("largest") > light)).drop("largest"))
    listed = cut(heavy.join(heads.select("shingle"), "shingle", "left_semi"))  # most lists hold copies of one set only
    small = nodes.filter(F.col("n") <= light).select("id")
    wanted = small.unionByName(listed.select("id")).distinct()
    sets = packed_sets(docs, text, doc_id, shingle, nodes.join(wanted, "id", "left_semi"))
    links = verified(head_pairs(listed, heads, percent), sets, percent)
    links = cut(links if small.isEmpty() else links.unionByName(light_links(sets.join(small, "id", "left_semi"), percent)))
    first = components(links)
    apart = cut(rest_pairs(listed, heads, first, percent))
    rest = apart if apart.isEmpty() else cut(verified(apart, sets, percent))
    parts = first if rest.isEmpty() else components(cut(links.unionByName(rest)))
    placed = nodes.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = placed.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    named = salted_join(placed, cut(names), ["component"], "sets", "id").select("node", "copies", "component_id")
    full = salted_join(rows.filter("n > 0"), cut(named), ["node"], "copies", "row")
    none = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "component_id").unionByName(none).withColumnRenamed("n", "n_shingles")
