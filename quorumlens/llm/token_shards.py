"""Token ids in compressed binary shards, by Re-Pair grammars.

Texts are sorted over the cluster by doc_id and encoded with the tokenizers library; ids go to shards of
about ``shard_ids`` ids, whole documents each. A shard repeatedly replaces its most frequent pairs of
adjacent ids by new symbols (never across a document's end). It stores the rules, the number of ids that each
symbol expands to, and each document's compressed symbols, so that one document, or a range within it, can be
decoded without the rest. A table of shards is Parquet, one row a shard, with binary columns in little-endian order:

====================  =======================================================================================
part, shard           the partition that wrote it and its number there; in this order shards ascend in doc_id
n_docs, n_ids         documents and ids (with end ids)
doc_ids               int64 for each document
symbol_ends           uint32 for each document: where its symbols end
symbols               uint32: ids below ``first_rule``, rules from there on
rules                 pairs of uint32: rule k stands for its two symbols
lengths               uint32 for each rule: ids that it expands to
====================  =======================================================================================

Defined results: null text is empty, so it has the end id only; rows that share a doc_id are ordered by text;
rows without doc_id come first; an empty table has no shards. Spark writes and commits the files, so a lost executor
leaves none half written.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.llm.common import small_batches, text_of

SCHEMA = "part int, shard int, n_docs int, n_ids bigint, first_rule bigint, doc_ids binary, has_id binary, symbol_ends binary, symbols binary, rules binary, lengths binary"
ROW = pa.schema([(name, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
#: Fixed value: the split pattern of the word vocabulary, for words of common Latin characters, and the ends of words.
LATIN_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: For Arrow: what is neither a common Latin character nor white space, or may begin a special token.
NOT_LATIN = r"[^!-~\x{85}\p{Z}\x{a1}-\x{b1}\x{b4}-\x{b8}\x{ba}\x{bb}\x{bf}-\x{24f}]|<[|]"
#: The letter that becomes two in lower case, but one in Arrow's.
DOTTED_I = "\u0130"
#: Pieces that a worker remembers, and bytes of text that it encodes together.
REMEMBERED, TOGETHER = 600_000, 8 << 20


class WordEncoder:
    """Ids of texts by a vocabulary file of the tokenizers library.

    White space separates what the library encodes independently, and its split pattern cuts words into pieces that it encodes
    independently too. So each different lower-case word of the texts is cut once, the library encodes each new piece once, and
    texts are put together from their words' ids. Arrow splits the texts and finds the different words. Texts with anything but
    common Latin characters, or with what may be a special token, the library encodes whole. Beyond ``REMEMBERED`` pieces, the
    half used least is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        self.library, self.alone = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.alone.normalizer = normalizers.Sequence([])  # common Latin pieces in lower case are normal already
        self.alone.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])  # and cut
        for t in (self.library, self.alone):
            t.no_padding()
            t.no_truncation()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.uses = np.empty(0, np.int64)
        self._keep(pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.uint32))

    def _keep(self, pieces: pa.StringArray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Sets what is remembered: pieces, their numbers of ids and ids."""
        self.pieces, self.sizes, self.flat = pieces, sizes, flat
        self.starts = np.cumsum(sizes) - sizes

    def encode(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        counts = words.value_lengths().to_numpy()
        words = words.flatten().dictionary_encode()
        numbers = words.indices.to_numpy()
        foreign = pc.match_substring_regex(words.dictionary, NOT_LATIN).to_numpy(zero_copy_only=False)
        whole = pc.match_substring(texts, DOTTED_I).to_numpy(zero_copy_only=False)
        if foreign.any():
            whole[np.repeat(np.arange(len(texts)), counts)[foreign[numbers]]] = True
        starts, sizes, ids = self._words(words.dictionary, foreign)
        sizes = sizes[numbers]
        stops = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        ids = _gather(ids, starts[numbers], sizes)
        return [
            np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) if w else ids[a:b]
            for k, (w, a, b) in enumerate(zip(whole.tolist(), stops, stops[1:], strict=False))
        ]

    def _words(self, words: pa.StringArray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each word's ids start, how many they are (foreign words: none), and the ids of all."""
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) & ~foreign  # one piece each
        mixed = ~letters & ~foreign
        found = LATIN_WORDS.findall("".join(f"{w}\n" for w in words.filter(pa.array(mixed)).to_numpy(zero_copy_only=False)))
        found = pa.array(found, pa.string())
        cuts = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
        pieces = pa.concat_arrays([words.filter(pa.array(letters)), found.filter(pa.array(~cuts))]).dictionary_encode()
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(mixed)])
        cuts = np.flatnonzero(cuts)
        of = np.repeat(order, np.append(np.ones(int(letters.sum()), np.int64), np.diff(cuts, prepend=-1) - 1))
        numbers = self._numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        sizes, starts = np.bincount(of, self.sizes[numbers], len(words)).astype(np.int64), np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return starts, sizes, _gather(self.flat, self.starts[numbers], self.sizes[numbers])

    def _numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """Numbers of different pieces among those remembered; new ones are added."""
        if len(self.pieces) > REMEMBERED:
            best = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
            self.uses = self.uses[best]
            self._keep(self.pieces.take(pa.array(best)), self.sizes[best], _gather(self.flat, self.starts[best], self.sizes[best]))
        numbers = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        unknown = numbers < 0
        numbers[unknown] = len(self.pieces) + np.arange(int(unknown.sum()))
        self._learn(pieces.filter(pa.array(unknown)))
        return numbers

    def _learn(self, new: pa.StringArray) -> None:
        """Adds the ids of new pieces."""
        sizes, parts, names = [self.sizes], [self.flat], new.to_numpy(zero_copy_only=False)
        for at in range(0, len(new), 300):
            some = names[at : at + 300]
            ids = np.array(self.alone.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                raise ValueError("the vocabulary's words do not all end in </w>")
            sizes.append(np.diff(cuts, prepend=0))
            parts.append(ids)
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        self._keep(pa.concat_arrays([self.pieces, new]), np.concatenate(sizes), np.concatenate(parts))


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    places += np.arange(len(places))
    return flat[places]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _same_pairs(first: np.ndarray, second: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order: the pairs' places, equal pairs together and ascending; where each kind starts in it; the kinds' two symbols, all below ``top``."""
    wide, low = int(top).bit_length(), len(first).bit_length()
    if 2 * wide + low <= 64:  # a pair and its place are one number
        keys = first << np.uint64(wide)
        keys |= second
        keys <<= np.uint64(low)
        keys |= np.arange(len(first), dtype=np.uint64)
        keys.sort()
        order = (keys & np.uint64((1 << low) - 1)).view(np.int64)
        keys >>= np.uint64(low)
    else:
        wide, keys = 32, (first << np.uint64(32)) | second
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    kinds = keys[starts]
    return order, starts, kinds >> np.uint64(wide), kinds & np.uint64((1 << wide) - 1)


def repair(ids: np.ndarray, doc_ends: np.ndarray, first_rule: int, per_round: int = 4096, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols, doc_ends within them, rules: each round replaces the most frequent pairs, until no pair comes ``least`` times.
    A rule takes 12 bytes and each replacement saves 4, so the fourth is the first to gain.

    Of overlapping pairs the more frequent kind wins, everywhere alike, so the most frequent kind of a round keeps all its places and every
    round gains. Symbols are a linked list, so that a round costs no more than the pairs it looks at: a pair can only become as frequent by a new
    symbol, so those are the pairs with one and those that were frequent before.
    """
    n = len(ids)
    symbols, rules, top = ids.astype(np.uint64), [], first_rule
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    last, gone = np.zeros(n + 1, bool), np.zeros(n, bool)
    last[doc_ends[doc_ends > 0] - 1] = True
    at = np.flatnonzero(~last[:n])
    while len(at):
        order, starts, firsts, seconds = _same_pairs(symbols[at], symbols[after[at]], top)
        places = np.diff(starts, append=len(at))
        counts, bound = places.copy(), np.empty(0, np.int64)
        twins = np.flatnonzero((firsts == seconds) & (counts >= least))
        if len(twins):  # of a run of one symbol every other pair can be replaced
            of = np.repeat(np.arange(len(twins)), places[twins])
            rows = _gather(order, starts[twins], places[twins])
            begins = np.flatnonzero(np.append(True, (after[at[rows[:-1]]] != at[rows[1:]]) | (of[:-1] != of[1:])))
            free = (np.arange(len(rows)) - np.repeat(begins, np.diff(begins, append=len(rows)))) % 2 == 0
            counts[twins], bound = np.bincount(of[free], minlength=len(twins)), rows[~free]
        chosen = np.flatnonzero(counts >= least)
        if not len(chosen):
            break
        kinds = (firsts << np.uint64(32)) | seconds
        mixed = (kinds[chosen] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        mixed |= (n - counts[chosen]).astype(np.uint64) << np.uint64(32)
        ranked = chosen[np.argsort(mixed, kind="stable")[:per_round]]  # the first win
        rank = np.full(len(kinds), -2, np.int32)  # -1: frequent, but not in this round
        rank[chosen] = -1
        rank[ranked] = np.arange(len(ranked), dtype=np.int32)
        own = np.empty(len(at), np.int32)
        own[order] = np.repeat(rank, places)
        own[bound] = np.minimum(own[bound], -1)
        frequent, some = at[own >= -1], np.flatnonzero(own >= 0)
        own, some = own[some], at[some]
        meets = after[some[:-1]] == some[1:]
        wins = np.ones(len(some), bool)
        wins[:-1] &= ~meets | (own[:-1] < own[1:])
        wins[1:] &= ~meets | (own[1:] < own[:-1])
        own, here = own[wins], some[wins]
        used = np.bincount(own, minlength=len(ranked)) >= least
        keep = used[own]
        hits, number, made = here[keep], np.cumsum(used) - 1, kinds[ranked[used]]
        rules.append(np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], 1))
        second = after[hits]
        symbols[hits] = (top + number[own[keep]]).astype(np.uint64)
        gone[second] = True
        last[hits] = last[second]
        after[hits] = after[second]
        inner = after[hits] < n
        before[after[hits[inner]]] = hits[inner]
        top += len(made)
        changed = np.concatenate([frequent, hits, before[hits][before[hits] >= 0]])
        if len(changed) > n // 64:
            marks = np.zeros(n, bool)
            marks[changed] = True
            at = np.flatnonzero(marks & ~gone & ~last[:n])
        else:
            at = np.unique(changed)
            at = at[~gone[at] & ~last[at]]
    kept = ~gone
    ends = np.flatnonzero(last[:n][kept]) + 1
    return symbols[kept].astype("<u4"), ends.astype("<u4"), (np.concatenate(rules) if rules else np.empty((0, 2))).astype("<u4")


def generations(rules: np.ndarray, first_rule: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules whose symbols all stand before the range."""
    low, begin = rules.max(1).astype(np.int64) - first_rule, 0
    while begin < len(rules):
        later = np.flatnonzero(low[begin:] >= begin)
        end = begin + int(later[0]) if len(later) else len(rules)
        yield begin, end
        begin = end


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    lengths = np.ones(len(rules), np.int64)
    for a, b in generations(rules, first_rule):
        two = rules[a:b].astype(np.int64) - first_rule
        lengths[a:b] = np.where(two >= 0, lengths[np.maximum(two, 0)], 1).sum(1)
    return lengths.astype("<u4")


class Grammar:
    """Decodes a shard's symbols."""

    def __init__(self, first_rule: int, rules: np.ndarray, lengths: np.ndarray):
        self.first_rule, self.rules, self.lengths = first_rule, rules, lengths.astype(np.int64)
        ends = np.cumsum(self.lengths)
        self.starts, self.flat = ends - self.lengths, np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for a, b in generations(rules, first_rule):
            self.flat[self.starts[a] : ends[b - 1]] = self.expand(rules[a:b].ravel())

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first_rule
        out[rule] = self.lengths[symbols[rule] - self.first_rule]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        sizes = self.sizes(symbols)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        within = np.arange(total) - np.repeat(ends - sizes, sizes)
        of = np.repeat(symbols, sizes)
        out = of.astype(np.uint32)
        rule = of >= self.first_rule
        out[rule] = self.flat[self.starts[of[rule] - self.first_rule] + within[rule]]
        return out

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document, expanding only the symbols that hold them."""
        ends = np.cumsum(self.sizes(symbols.astype(np.int64)))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : stop - before]


def write_shards(docs: DataFrame, tokenizer: str, target: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 2, shard_ids: int = 1_000_000) -> None:
    """Writes the ids of ``docs`` to the Parquet table ``target``."""
    small_batches()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def shard(number: int, ids: list, arrays: list[np.ndarray]) -> dict:
        flat = np.concatenate(arrays)
        first_rule = int(max(flat.max() + 1, 1 << 16))
        symbols, ends, rules = repair(flat, np.cumsum([len(a) for a in arrays]), first_rule)
        has = np.array([i is not None for i in ids])
        return {
            "part": TaskContext.get().partitionId(), "shard": number, "n_docs": len(ids), "n_ids": len(flat), "first_rule": first_rule,
            "doc_ids": np.array([0 if i is None else i for i in ids], "<i8").tobytes(), "has_id": np.packbits(has).tobytes(), "symbol_ends": ends.tobytes(),
            "symbols": symbols.tobytes(), "rules": rules.tobytes(), "lengths": rule_lengths(rules, first_rule).tobytes(),
        }

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], np.uint32)
        number, size, ids, arrays = 0, 0, [], []
        for batch in _together(batches):
            for i, a in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                ids.append(i)
                arrays.append(np.concatenate([a, end]))
                size += len(a) + 1
                if size >= shard_ids:
                    yield pa.RecordBatch.from_pylist([shard(number, ids, arrays)], ROW)
                    number, size, ids, arrays = number + 1, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([shard(number, ids, arrays)], ROW)

    ordered.mapInArrow(write, SCHEMA).write.parquet(target)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``TOGETHER`` bytes (and one row at least); a row counts 64 bytes and its text."""
    held, total = [], 0
    for batch in batches:
        ends = total + np.cumsum(pc.binary_length(batch["text"]).to_numpy().astype(np.int64) + 64)
        start = 0
        for stop in (np.flatnonzero(np.diff(ends // TOGETHER, prepend=total // TOGETHER)) + 1).tolist():
            yield pa.concat_batches([*held, batch.slice(start, stop - start)])
            held, start = [], stop
        held, total = [*held, batch.slice(start)], int(ends[-1]) if len(ends) else total
    if sum(map(len, held)):
        yield pa.concat_batches(held)


def read_documents(shards: DataFrame) -> DataFrame:
    """part, shard, position, doc_id, offset (ids before it in the shard) and ids (packed) of each document of a shard table."""

    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("position", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in chain.from_iterable(batch.to_pylist() for batch in batches):
            symbols, ends = np.frombuffer(s["symbols"], "<u4"), np.frombuffer(s["symbol_ends"], "<u4")
            grammar = Grammar(s["first_rule"], np.frombuffer(s["rules"], "<u4").reshape(-1, 2), np.frombuffer(s["lengths"], "<u4"))
            no_id = np.unpackbits(np.frombuffer(s["has_id"], np.uint8))[: s["n_docs"]] == 0
            doc_ids = np.frombuffer(s["doc_ids"], "<i8")
            ids = grammar.expand(symbols).astype("<u4")
            stops = np.append(0, np.cumsum(grammar.sizes(symbols.astype(np.int64)))[ends.astype(np.int64) - 1])
            for at in range(0, s["n_docs"], 256):
                span, cuts = slice(at, at + 256), stops[at : at + 257]
                n = len(cuts) - 1
                places = [pa.py_buffer(((cuts - cuts[0]) * 4).astype(np.int32)), pa.py_buffer(ids[cuts[0] : cuts[-1]])]
                columns = [np.full(n, s["part"], np.int32), np.full(n, s["shard"], np.int32), np.arange(at, at + n, dtype=np.int32), pa.array(doc_ids[span], mask=no_id[span]), cuts[:-1]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.Array.from_buffers(pa.binary(), n, [None, *places])], schema=kinds)

    columns = ["part", "shard", "n_docs", "first_rule", "doc_ids", "has_id", "symbol_ends", "symbols", "rules", "lengths"]
    return shards.select(*columns).mapInArrow(read, "part int, shard int, position int, doc_id bigint, offset bigint, ids binary")


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard, shard_start: the ids of all shards before each. One row a part meets in the unpartitioned window."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    within = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return shards.select("part", "shard", within.alias("in_part")).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("shard_start"))


def with_starts(documents: DataFrame, shards: DataFrame) -> DataFrame:
    """``documents`` (part, shard, offset and any other columns) with start, the number of ids of all documents before."""
    return documents.join(shard_starts(shards), ["part", "shard"]).withColumn("start", F.col("shard_start") + F.col("offset"))
