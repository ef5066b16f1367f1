"""Benchmark decontamination by template canonicalisation.

A text becomes a template: words are lower-cased and stripped of outer punctuation; numbers, units that follow a number
and names (capitalised words that begin no sentence) become typed placeholders, whose values are kept as slots. Windows of
``window`` template words are hashed and joined to the windows of the benchmark items. On a diagonal (fixed distance
between the position in the document and in the item) the slots must be consistent: one value of an item always
stands for one value in the document, so a re-parameterised question matches and a loose likeness does not. A
document is contaminated by an item if consistent windows cover ``min_words`` of its words, or all of a shorter item.

``whole`` (the registered query and the pipeline set it) judges runs and not diagonals: the windows that count are the longest
run of consistent ones, or those that agree with the most frequent counterpart of each slot value, whichever cover more words.
So one slip in a long copy costs the windows that hold it. It also hashes every window of the words as they are, so that windows
of many slots and items of any length are found as exact copies (in any case of letters), while their templates do not match; with
the first words of sentences as names, so that "Tom has" asked as "Eve has" matches; and with names as plain words, so that a copy
in upper or lower case with other numbers does. Other names in one case of letters cannot be told from words within a sentence. Without ``whole`` a diagonal with one inconsistent value counts for nothing.

Documents only send the windows that can match: a bitmap over the hashes of all benchmark windows, sixteen bits a window and 16 MB
at most, without false negatives, sorts out the others where the text is read. A full one only passes more windows to the join. The benchmark's windows
are sent to every executor while they are few; beyond that, windows that very many documents hold are spread over salts where they meet the items.

Defined results: null and empty texts have no windows; items shorter than the window are one window of their own length, and
items of fewer than ``shortest`` words, or windows with fewer than ``shortest`` plain words (unless the whole item
has no more), are too common to tell and never match as templates, and without ``whole`` never at all. A document is its doc_id and
text: rows that repeat both are found together, texts that share an id, or have none, each for itself.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import FEW, by_slices, cut, free_name, salted_join, small_batches, text_of

#: Words that are units after a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours minutes seconds days weeks months years % percent usd eur dollars euros cents degrees °c °f kph mph km/h kw kwh".split())
OUTER = string.punctuation.replace("%", "").replace("$", "") + "«»“”„’‘¿¡…–—"
NUMBER = re.compile(r"[-+$€£]?\d[\d.,/:]*%?")
#: Bits of a hash that the bitmap knows, at least and at most.
LEAST_BITS, MOST_BITS = 20, 27
#: Characters of the items' slots and ids that are sent to every executor at most.
MOST_SENT = 1 << 24
#: Texts whose windows are hashed together.
TOGETHER = 200
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = "<number>", "<name>", "<unit>"
SLOT_HASHES = np.array([0, *(xxhash.xxh64_intdigest(x) for x in (NUMBER_SLOT, UNIT_SLOT, NAME_SLOT))], np.uint64)


PLAIN, NUMBER_KIND, UNIT_KIND, NAME_KIND = range(4)


class Tokens(dict):
    """A number for each token, with what is known of it alone; bounded."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.low: list[str] = []
        self.facts: list[tuple[int, bool, bool, bool, bool, bool, bool]] = []
        self.table = np.zeros(0, [("hash", "u8"), ("empty", "?"), ("number", "?"), ("unit", "?"), ("name", "?"), ("ends", "?"), ("letter", "?")])

    def __missing__(self, token: str) -> int:
        core = token.strip(OUTER)
        low = core.lower()
        self.low.append(low)
        ends = token[-1] in (".!?:" if core else ".!?")
        self.facts.append((xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")), not core, NUMBER.fullmatch(core) is not None, low in UNITS, core[:1].isupper() and not core.isupper(), ends, core[:1].isalpha()))
        self[token] = number = len(self.low) - 1
        return number

    def known(self) -> np.ndarray:
        if self.facts:
            self.table, self.facts = np.concatenate([self.table, np.array(self.facts, self.table.dtype)]), []
        return self.table


class Templates:
    """The templates of some texts, one after the other: low (the words), kind, hash, and bounds (where each text starts)."""

    def __init__(self, texts: list[str], tokens: Tokens):
        if len(tokens) > 400_000:
            tokens.forget()
        split = [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(tokens.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        facts = tokens.known()[numbers]
        text = np.repeat(np.arange(len(texts)), counts)
        ended = np.cumsum(facts["ends"]) - facts["ends"]  # sentence ends before each token
        keep = np.flatnonzero(~facts["empty"])
        facts, text, ended, self.numbers = facts[keep], text[keep], ended[keep], numbers[keep]
        first = np.diff(text, prepend=-1) != 0
        begins = first | (np.diff(ended, prepend=0) > 0)
        after_number = np.append(False, facts["number"][:-1]) & ~first
        self.kind = np.select([facts["number"], after_number & facts["unit"], facts["name"] & ~begins], [NUMBER_KIND, UNIT_KIND, NAME_KIND], PLAIN)
        self.hash = np.where(self.kind == PLAIN, facts["hash"], SLOT_HASHES[self.kind])
        self.exact = facts["hash"].copy()  # without placeholders
        self.starts = begins & facts["letter"] & (self.kind == PLAIN)
        self.bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        self.text, self.low = text, tokens.low

    def readings(self, whole: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Kinds and hashes of the words: with placeholders; for ``whole`` also with sentences' first words as names, with names as words, and as they are."""
        kinds = [self.kind]
        if whole:
            kinds += [np.where(self.starts, NAME_KIND, self.kind), np.where(self.kind == NAME_KIND, PLAIN, self.kind), np.full(len(self.kind), PLAIN)]
        return [(kind, np.where(kind == PLAIN, self.exact, SLOT_HASHES[kind])) for kind in kinds]

    def slots(self, a: int, b: int, kind: np.ndarray | None = None) -> list[str]:
        """The slot values of words a to b (empty: a plain word)."""
        kind = self.kind if kind is None else kind
        return [self.low[n] if k else "" for n, k in zip(self.numbers[a:b].tolist(), kind[a:b].tolist(), strict=True)]

    def words(self, a: int, b: int) -> list[str]:
        return [(self.low[n], NUMBER_SLOT, UNIT_SLOT, NAME_SLOT)[k] for n, k in zip(self.numbers[a:b].tolist(), self.kind[a:b].tolist(), strict=True)]


def template(text: str) -> tuple[list[str], list[str]]:
    """Template words of a text, and for each the slot value (empty: a plain word)."""
    t = Templates([text], Tokens())
    return t.words(0, len(t.kind)), t.slots(0, len(t.kind))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every ``size`` word hashes, mixed."""
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[k : k + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def whole_windows(made: Templates, a: int, b: int, size: int, window: int, shortest: int) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Position, hash and slots of the windows of the item that is words a to b, in each reading that says enough to match."""
    readings = made.readings(True)
    base = readings[0][0][a:b] == PLAIN
    for n, (kind, hashes) in enumerate(readings):
        plain, slots = kind[a:b] == PLAIN, made.slots(a, b, kind)
        for k, h in enumerate(window_hashes(hashes[a:b], size).view(np.int64).tolist()):
            words, own = int(base[k : k + size].sum()), int(plain[k : k + size].sum())
            least = max(min(shortest, words) if b - a <= window else shortest, 1)
            told = words >= least  # the first words of sentences count as words here, whatever the reading
            if n == 3 or size >= shortest and (told, told and own >= max(min(3, words - 1), 1), own >= shortest)[n]:
                yield k, h, tuple(slots[k : k + size])


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int, shortest: int, whole: bool = False) -> DataFrame:
    """item_id, size, n_words, position, hash and slots of the windows of all items."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            rows, made = [], Templates(batch["text"].tolist(), tokens)
            for item, a, b in zip(batch["item_id"], made.bounds.tolist(), made.bounds[1:].tolist(), strict=False):
                size, slots, hashes = min(window, b - a), made.slots(a, b), made.hash[a:b]
                if whole:
                    rows += {(item, size, b - a, *w): None for w in whole_windows(made, a, b, size, window, shortest)} if b > a else {}
                    continue
                if size < shortest:
                    continue
                variants = [(slots, hashes)]
                if not slots[0] and made.words(a, a + 1)[0][0].isalpha():  # a document may quote the item within a sentence
                    variants.append(([*made.words(a, a + 1), *slots[1:]], np.append(SLOT_HASHES[NAME_KIND], hashes[1:])))
                for n, (slots, hashes) in enumerate(variants):
                    plain = np.array([not x for x in slots])
                    least = min(shortest, int(plain.sum()) if b - a <= window else shortest)
                    at = range(1 if n else b - a - size + 1)  # they differ in the first word
                    for k, h in zip(at, window_hashes(hashes, size).view(np.int64).tolist()):
                        if plain[k : k + size].sum() >= max(least, 1):
                            rows.append((item, size, b - a, k, h, slots[k : k + size]))
            yield pd.DataFrame(rows, columns=["item_id", "size", "n_words", "item_position", "hash", "item_slots"])

    columns = benchmark.select(F.col(item_id).alias("item_id"), text_of(text).alias("text"))
    return columns.mapInPandas(make, f"item_id {columns.schema['item_id'].dataType.simpleString()}, size int, n_words int, item_position int, hash bigint, item_slots array<string>")


def document_windows(docs: DataFrame, doc_id: str, text: str, sizes: list[int], bitmap: np.ndarray, shortest: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, text_hash, size, position, hash and slots of the windows that the bitmap passes."""
    small_batches()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # of fixed size

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, bits = Tokens(), shared.value
        shift = np.uint64(64 - (len(bits).bit_length() + 2))  # the bitmap has 8 bits a byte, and a power of two of them
        for batch in batches:
            rows, ids, hashes = [], batch["doc_id"].tolist(), batch["text_hash"].tolist()
            for start in range(0, len(batch), TOGETHER):
                made = Templates(batch["text"].iloc[start : start + TOGETHER].tolist(), tokens)
                for size in sizes:
                    seen: list[np.ndarray] = []
                    for kind, words in made.readings(whole):
                        h = window_hashes(words, size)
                        at = h >> shift
                        passes = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        for other in seen:  # read alike, once
                            passes &= h != other
                        seen.append(h)
                        passed = np.flatnonzero(passes)
                        passed = passed[made.text[passed] == made.text[passed + size - 1]]  # within one text
                        if size < shortest:  # the window is all of an item: once a text is enough
                            passed = passed[np.unique(np.stack([made.text[passed], h[passed].view(np.int64)]), axis=1, return_index=True)[1]]
                        for k, t, x in zip(passed.tolist(), made.text[passed].tolist(), h[passed].view(np.int64).tolist(), strict=True):
                            rows.append((ids[start + t], hashes[start + t], size, k - int(made.bounds[t]), x, made.slots(k, k + size, kind)))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "size", "position", "hash", "slots"])

    columns = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text_of(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))  # ids as texts: pandas has no null integers
    found = columns.mapInPandas(make, "doc_id string, text_hash bigint, size int, position int, hash bigint, slots array<string>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def bitmap_of(windows: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the hashes' first ``bits`` bits, made on the executors; pages of 32,768 bits go to the driver, at most 4,096 of them."""
    at = F.shiftrightunsigned("hash", 64 - bits) + 1
    pages = windows.select(F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bytes"))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for page in pages.collect():
        start = (page["page"] - 1) * 4096
        bitmap[start : start + 4096] = np.frombuffer(page["bytes"], np.uint8)
    return bitmap


def best_windows(hits: list[dict], size: int) -> tuple[int, bool]:
    """Words that the best consistent windows of a diagonal cover, and whether one of their slots has another value. hits: at, and pairs of slot values."""
    hits = sorted((x["at"], [(p["item_slots"], p["slots"]) for p in x["pairs"]]) for x in hits)
    votes = Counter(p for _, pairs in hits for p in pairs)
    chosen: dict[str, str] = {}
    for item, said in sorted(votes, key=lambda p: (-votes[p], p[0] != p[1], p)):  # of equally frequent ones the same value
        chosen.setdefault(item, said)
    best = _covered([x for x in hits if all(chosen[a] == b for a, b in x[1])], size)
    start = 0
    held: Counter[tuple[str, str]] = Counter()  # pairs of the run of windows from start
    means: dict[str, str] = {}
    for end, (_, pairs) in enumerate(hits):
        own = dict(pairs)
        while start < end and any(means.get(a, b) != b for a, b in own.items()):
            for p in hits[start][1]:
                held[p] -= 1
                if not held[p]:
                    means.pop(p[0], None)
            start += 1
        if any(own[a] != b for a, b in pairs):  # not consistent by itself, so no run holds it
            start, held, means = end + 1, Counter(), {}
            continue
        held.update(pairs)
        means |= own
        if end + 1 == len(hits) or _breaks(means, hits[end + 1][1]):
            best = max(best, _covered(hits[start : end + 1], size), key=lambda x: (x[0], not x[1]))
    return best


def _breaks(means: dict[str, str], pairs: list[tuple[str, str]]) -> bool:
    return any(means.get(a, b) != b for a, b in pairs) or len(dict(pairs)) < len(set(pairs))


def _covered(hits: list[tuple[int, list[tuple[str, str]]]], size: int) -> tuple[int, bool]:
    return len({k for at, _ in hits for k in range(at, at + size)}), any(a != b for _, pairs in hits for a, b in pairs)


def judged_runs(hits: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_words, covered and reworded of each diagonal's best windows. hits: with item_position, diagonal and pairs."""
    lines = hits.groupBy("doc_id", "text_hash", "item_id", "n_words", "size", "diagonal").agg(F.collect_set(F.struct(F.col("item_position").alias("at"), "pairs")).alias("hits"))
    kind = pa.struct([("covered", pa.int32()), ("reworded", pa.bool_())])
    make = lambda: lambda hits, sizes: [dict(zip(("covered", "reworded"), best_windows(h, n), strict=True)) for h, n in zip(hits, sizes, strict=True)]
    judged = by_slices("struct<covered:int,reworded:boolean>", kind, make, F.col("hits"), F.col("size"))
    return lines.select("doc_id", "text_hash", "item_id", "n_words", judged.alias("best")).select("doc_id", "text_hash", "item_id", "n_words", "best.*")


def judged_diagonals(hits: DataFrame) -> DataFrame:
    """As `judged_runs`, of the diagonals that are consistent as a whole."""
    lines = hits.groupBy("doc_id", "text_hash", "item_id", "n_words", "size", "diagonal").agg(F.array_sort(F.collect_set("item_position")).alias("at"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["item_slots"])))
    covered = F.aggregate("at", F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + F.col("size")).alias("end"), (a["n"] + F.least(F.col("size"), p + F.col("size") - a["end"])).alias("n")))["n"]
    reworded = F.exists("pairs", lambda x: x["item_slots"] != x["slots"])
    return lines.filter(consistent).select("doc_id", "text_hash", "item_id", "n_words", covered.alias("covered"), reworded.alias("reworded"))


def _characters(items: DataFrame) -> int:
    """Of the windows' slots and ids."""
    slots = F.aggregate("item_slots", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return items.agg(F.sum(slots + F.length(F.col("item_id").cast("string")))).first()[0] or 0


def met_by_salts(found: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of documents with the items' windows of the same hash and size; those that very many documents hold are spread over salts."""
    key = ["hash", "size"]
    found = cut(found)
    own = items.groupBy(*key).agg(F.collect_list(F.struct(*[c for c in items.columns if c not in key])).alias("own"))
    uses = found.groupBy(*key).agg(F.count(F.lit(1)).alias("uses"))
    met = salted_join(found, cut(own.join(uses, key)), key, "uses", "text_hash")
    return met.select(*found.columns, F.explode("own").alias("own")).select(*found.columns, "own.*")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, min_words: int = 13, shortest: int = 5, whole: bool = False, few: int = FEW) -> DataFrame:
    """doc_id, text_hash, item_id, covered_words, n_words (of the item), reworded (some slot has another value): one row for each contaminated pair.

    A document is its doc_id and text (xxhash64), so texts that share an id, and those without one, are judged each for itself; repeated rows are one.
    """
    items = cut(item_windows(benchmark, item_id, item_text, window, shortest, whole))
    n = items.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` values
    found = document_windows(docs, doc_id, text, sizes, bitmap_of(items, bits), shortest, whole)
    hits = found.join(F.broadcast(items), ["hash", "size"]) if n <= few and _characters(items) <= MOST_SENT else met_by_salts(found, items)
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda x: (x["item_slots"] != "") | (x["slots"] != ""))
    lines = hits.select("doc_id", "text_hash", "item_id", "n_words", "size", "item_position", (F.col("position") - F.col("item_position")).alias("diagonal"), pairs.alias("pairs"))
    scored = judged_runs(lines) if whole else judged_diagonals(lines)
    best = scored.groupBy("doc_id", "text_hash", "item_id", "n_words").agg(F.max("covered").alias("covered_words"), F.min("reworded").alias("reworded"))
    return best.filter(F.col("covered_words") >= F.least(F.lit(min_words), F.col("n_words"))).select("doc_id", "text_hash", "item_id", "covered_words", "n_words", "reworded")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; rows that share a doc_id, or have none, go or stay by their own texts."""
    mark, own = free_name(docs, "contaminated"), free_name(docs, "contaminated_text")
    found = find_contamination(docs, benchmark, doc_id=doc_id, text=text, **options).select(F.col("doc_id").alias(mark), F.col("text_hash").alias(own)).distinct()
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(mark)) & (F.xxhash64(text_of(text)) == F.col(own)), "left_anti")
