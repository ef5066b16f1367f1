"""Distances between texts."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType


#: Pairs of texts whose words are compared together, one pair a lane of 64 bits.
LANES = 2048


def word_distances(first: pa.Array, second: pa.Array) -> np.ndarray:
    """Edit distances of two columns of word arrays, many pairs at once: each different word of the batch is a number, and where one side has at most 64 words a column of a pair's
    table is a lane of 64 bits (`_lanes`). Pairs with more on both sides take `word_distance`.
    """
    n, m = (pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (first, second))
    coded = pa.chunked_array([first.flatten(), second.flatten()], pa.string()).dictionary_encode()
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if len(coded) else np.zeros(0, np.int32)
    x, y, far = np.cumsum(n) - n, np.cumsum(m) - m + n.sum(), np.maximum(n, m)
    turned = (n >= m) != (far <= 64)  # the longer side stands in the lanes, if it fits
    at, rows, to, columns = np.where(turned, y, x), np.where(turned, m, n), np.where(turned, x, y), np.where(turned, n, m)
    for k in np.flatnonzero(rows > 64):
        far[k] = word_distance(codes[at[k] : at[k] + rows[k]].tolist(), codes[to[k] : to[k] + columns[k]].tolist())
    some = np.flatnonzero((rows > 0) & (columns > 0) & (rows <= 64))
    some = some[np.lexsort((rows[some], -columns[some]))]
    for k in range(0, len(some), LANES):
        part = some[k : k + LANES]
        far[part] = _lanes(codes, at[part], rows[part], to[part], columns[part])
    return far


def _lanes(codes: np.ndarray, at: np.ndarray, rows: np.ndarray, to: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of codes[at:at + rows] and codes[to:to + columns], most columns first: `_block` with a lane for each pair."""
    one, wide = np.uint64(1), int(-(-rows.max() // 8))
    spans = np.arange(8 * wide)
    words = np.where(spans < rows[:, None], codes[np.minimum(at[:, None] + spans, len(codes) - 1)], -1)
    up, down, last = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), np.uint64), one << (rows - 1).astype(np.uint64)
    bits, far = np.zeros((len(rows), 8), np.uint8), rows.copy()
    for j in range(int(columns[0])):
        live = int(np.searchsorted(-columns, -j))
        bits[:live, :wide] = np.packbits(words[:live] == codes[to[:live] + j][:, None], bitorder="little").reshape(live, wide)
        same, u, d = bits[:live].view("<u8")[:, 0], up[:live], down[:live]
        stays, match = same | d, (((same & u) + u) ^ u) | same
        more, less = d | ~(match | u), u & match
        far[:live] += (more & last[:live] != 0).astype(np.int64) - (less & last[:live] != 0)
        more, less = more << one | one, less << one
        up[:live], down[:live] = less | ~(stays | more), more & stays
    return far


@F.arrow_udf(LongType())
def word_errors(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """`word_distances` of two columns of word arrays."""
    return pa.array(word_distances(reference, hypothesis), pa.int64())


#: Words of the longer side that are compared at once, a bit each.
BITS = 8192


def word_distance(first: list[str], second: list[str]) -> int:
    """Edit distance of two lists of words of any length. Differences of neighbouring cells of the table are bits of whole numbers, a column at a time (Myers 1999, with carries between blocks of
    `BITS` rows), so a column of a block costs some operations on numbers of a kilobyte, whatever the words.
    """
    start, end = 0, min(len(first), len(second))
    while start < end and first[start] == second[start]:
        start += 1
    first, second = first[start:], second[start:]
    end = 0
    while end < min(len(first), len(second)) and first[-1 - end] == second[-1 - end]:
        end += 1
    first, second = first[: len(first) - end], second[: len(second) - end]
    rows, columns = (first, second) if len(first) >= len(second) else (second, first)
    if not columns:
        return len(rows)
    steps = [1] * len(columns)  # from one column to the next, along the row above a block
    for at in range(0, len(rows), BITS):
        steps = _block(rows[at : at + BITS], columns, steps)
    return len(rows) + sum(steps)


def _block(rows: list[str], columns: list[str], above: list[int]) -> list[int]:
    """The steps (-1, 0, 1) along the last row of a block, from those along the row above it."""
    full, last = (1 << len(rows)) - 1, 1 << (len(rows) - 1)
    places: dict[str, int] = {}
    for k, word in enumerate(rows):
        places[word] = places.get(word, 0) | 1 << k
    up, down, out = full, 0, []  # rows where the column steps by +1, by -1
    for word, step in zip(columns, above, strict=True):
        same = places.get(word, 0)
        stays = same | down
        if step < 0:
            same |= 1
        match = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(match | up)), up & match
        out.append(1 if more & last else -1 if less & last else 0)
        more, less = more << 1 & full | (step > 0), less << 1 & full | (step < 0)
        up, down = less | (full & ~(stays | more)), more & stays
    return out


#: Words of the longer sides that stand together in one number, and those from which on a pair is counted by itself.
PACKED, ALONE = 1 << 14, 1 << 12


def long_distances(first: pa.Array, second: pa.Array) -> np.ndarray:
    """`word_distance` of two columns of word arrays: the longer sides of many pairs stand in one whole number side by side, so that Python's own cost of a column is that of all of them."""
    n, m = (pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (first, second))
    coded = pa.chunked_array([first.flatten(), second.flatten()], pa.string()).dictionary_encode()
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if len(coded) else np.zeros(0, np.int32)
    x, y, turned, far = np.cumsum(n) - n, np.cumsum(m) - m + n.sum(), n < m, np.maximum(n, m)
    at, rows, to, columns = np.where(turned, y, x), np.maximum(n, m), np.where(turned, x, y), np.minimum(n, m)
    words = lambda k: (codes[at[k] : at[k] + rows[k]].tolist(), codes[to[k] : to[k] + columns[k]].tolist())
    some = np.flatnonzero(columns > 0)
    for k in some[rows[some] >= ALONE].tolist():
        far[k] = word_distance(*words(k))
    some = some[rows[some] < ALONE]
    some = some[np.argsort(-columns[some], kind="stable")]
    groups = np.cumsum(rows[some]) // PACKED
    for part in np.split(some, np.flatnonzero(np.diff(groups)) + 1):
        if len(part):
            far[part] = _packed([words(k) for k in part.tolist()])
    return far


def _packed(pairs: list[tuple[list[int], list[int]]]) -> list[int]:
    """Distances of rows and columns, most columns first: `_block` on all rows at once. A pair has whole bytes, with a bit at least after its rows that ends the sum's carry."""
    wides = [len(rows) // 8 + 1 for rows, _ in pairs]
    starts = [8 * k for k in accumulate(wides, initial=0)]
    full = sum(((1 << len(rows)) - 1) << at for (rows, _), at in zip(pairs, starts, strict=False))
    first, most, places = sum(1 << at for at in starts[:-1]), len(pairs[0][1]), []
    for (rows, columns), wide in zip(pairs, wides, strict=True):
        bits: dict[int, int] = {}
        for k, word in enumerate(rows):
            bits[word] = bits.get(word, 0) | 1 << k
        none, packed = bytes(wide), {word: value.to_bytes(wide, "little") for word, value in bits.items()}
        places.append([packed.get(word, none) for word in columns] + [none] * (most - len(columns)))
    up, down, out, left = full, 0, [0] * len(pairs), len(pairs)
    for j, parts in enumerate(zip(*places, strict=True), 1):
        same = int.from_bytes(b"".join(parts), "little")
        stays = same | down
        match = (((same & up) + up) ^ up) | same
        more, less = ((match | up) ^ full) | down, (up & match) << 1
        more = more << 1 | first  # what passes a pair's end falls on the next one's first bit, which is set, or is cut off below
        up, down = (((stays | more) ^ full) | less) & full, more & stays
        while left and len(pairs[left - 1][1]) == j:  # the last column of a pair: its corner is the first row's, and the steps down
            left -= 1
            mask = (1 << len(pairs[left][0])) - 1
            out[left] = j + (up >> starts[left] & mask).bit_count() - (down >> starts[left] & mask).bit_count()
    return out


@F.arrow_udf(LongType())
def long_word_errors(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """`long_distances` of two columns of word arrays."""
    return pa.array(long_distances(reference, hypothesis), pa.int64())


#: Second texts from this length on take the standard library's way, which passes over their frequent characters.
LONG = 200
#: Pairs whose blocks are looked for together.
TOGETHER = 1024


def match_ratios(firsts: list[str], seconds: list[str]) -> np.ndarray:
    """Twice the matching characters over all, of each first text against its second (the order matters): the longest common block, the earliest of equals,
    then the same on both sides of it, for many pairs at once. Equal to SequenceMatcher(None, first, second).ratio().
    """
    out, short = np.ones(len(firsts)), []
    for k, (x, y) in enumerate(zip(firsts, seconds, strict=True)):
        if x == y:
            continue
        if len(y) < LONG:
            short.append(k)
        else:
            out[k] = SequenceMatcher(None, x, y).ratio()
    if short:
        x, y = [firsts[k] for k in short], [seconds[k] for k in short]
        n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (x, y))
        codes = [np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.int32) + 2 for t in (x, y)]  # 0 and 1 stand after the ends
        top = max(int(c.max(initial=0)) for c in codes)
        small = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int32
        out[short] = 2 * _matching(*[c.astype(small) for c in codes], n, m) / (n + m)
    return out


def _matching(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Matching characters of each pair; x, y: all first and all second texts, one after the other, of lengths n and m."""
    pair, total = np.arange(len(n)), np.zeros(len(n), np.int64)
    lo, at = np.cumsum(n) - n, np.cumsum(m) - m
    hi, to = lo + n, at + m
    while len(pair):
        some = (hi > lo) & (to > at)
        pair, lo, hi, at, to = (v[some] for v in (pair, lo, hi, at, to))
        order = np.lexsort((to - at, hi - lo))
        pair, lo, hi, at, to = (v[order] for v in (pair, lo, hi, at, to))
        size, i, j = (np.zeros(len(pair), np.int64) for _ in range(3))
        for k in range(0, len(pair), TOGETHER):
            part = slice(k, k + TOGETHER)
            size[part], i[part], j[part] = _longest(x, y, lo[part], hi[part], at[part], to[part])
        found = size > 0
        pair, lo, hi, at, to, size, i, j = (v[found] for v in (pair, lo, hi, at, to, size, i, j))
        total += np.bincount(pair, size, minlength=len(n)).astype(np.int64)
        pair, lo, hi, at, to = np.append(pair, pair), np.append(lo, i + size), np.append(i, hi), np.append(at, j + size), np.append(j, to)
    return total


def _longest(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and places of the longest common block of each x[lo:hi] and y[at:to]: a pair a column, so that each step is one operation on bytes. Blocks are shorter than `LONG`, which fits a byte."""
    rows, wide = int((hi - lo).max()), int((to - at).max())
    down, across = np.arange(rows)[:, None], np.arange(wide)[:, None]
    a = np.where(down < hi - lo, x[np.minimum(lo + down, len(x) - 1)], x.dtype.type(0))
    b = np.where(across < to - at, y[np.minimum(at + across, len(y) - 1)], y.dtype.type(1))
    run, longer, same = np.zeros((wide + 1, len(lo)), np.uint8), np.empty((wide, len(lo)), np.uint8), np.empty((wide, len(lo)), bool)  # the block that ends here; the first row stays 0
    size, end = np.zeros(len(lo), np.uint8), np.zeros(len(lo), np.int64)
    for k in range(rows):
        np.equal(b, a[k], out=same)
        np.add(run[:-1], np.uint8(1), out=longer)
        np.multiply(longer, same.view(np.uint8), out=run[1:])
        value = run[1:].max(0)
        np.copyto(end, k + 1, where=value > size)
        np.maximum(size, value, out=size)
    size = size.astype(np.int64)
    i, here = lo + end - size, np.ones((wide, len(lo)), bool)  # here: whether the block is found from this place on
    for k in range(int(size.max())):
        fits = np.equal(b[k:], x[np.minimum(i + k, len(x) - 1)])
        here[: wide - k] &= np.logical_or(fits, k >= size, out=fits)
    return size, i, at + here.argmax(0)


@F.pandas_udf(DoubleType())
def matching_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """`match_ratios` of two columns; null is empty."""
    for a, b in pairs:
        yield pd.Series(match_ratios([x or "" for x in a], [y or "" for y in b]), dtype=float)


def _pairs(ordered: bool):
    @F.pandas_udf(ArrayType(DoubleType()))
    def ratios(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [_of_rows(batch.iloc[at : at + 500].tolist(), ordered) for at in range(0, len(batch), 500)]
            yield pd.Series(list(chain.from_iterable(parts)), dtype=object)

    return ratios


def _of_rows(rows: list, ordered: bool) -> list[list[float]]:
    pairs = [[(a, b) for i, a in enumerate(t) for j, b in enumerate(t) if (i != j if ordered else i < j)] for t in rows]
    found = match_ratios([a for p in pairs for a, _ in p], [b for p in pairs for _, b in p]).tolist()
    ends = np.cumsum([len(p) for p in pairs]).tolist()
    return [found[end - len(p) : end] for p, end in zip(pairs, ends, strict=True)]


#: Ratios of the pairs of an array of texts, row by row: each text against every other, or against the later ones only. Panels are small.
ordered_ratios, later_ratios = _pairs(True), _pairs(False)


#: Characters whose n-grams are counted together, or those of one pair.
CHARACTERS = 1 << 17


def gram_counts(first: pa.Array, second: pa.Array, order: int) -> np.ndarray:
    """Distinct character n-grams of each pair of texts without their white space, for each n up to ``order``: those of the first, of the second and of both (order x 3 x pairs).
    Many pairs are counted at once: a gram is a number of its pair, characters and side, and one sort brings equal ones together. Null is empty.
    """
    texts, out = [a.fill_null("") for a in (first, second)], np.zeros((order, 3, len(first)), np.int64)
    ends = np.cumsum(sum(pc.utf8_length(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in texts))
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHARACTERS)) + 1).tolist(), len(first)]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        _grams([a[start:stop].to_pylist() for a in texts], out[:, :, start:stop])
    return out


def _grams(texts: list[list[str]], out: np.ndarray) -> None:
    """`gram_counts` of some pairs, into ``out``."""
    pairs = out.shape[2]
    rows = list(chain.from_iterable(zip(*texts, strict=True)))
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.int32)
    dark = (codes != 32) & ((codes < 9) | (codes > 13))
    codes = codes[dark]
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    bits = width = int(np.count_nonzero(seen)).bit_length()
    small = np.int32 if pairs.bit_length() + bits * len(out) < 31 else np.int64
    codes = (np.cumsum(seen) - 1).astype(small)[codes]  # characters are numbered
    text = np.repeat(np.arange(len(rows), dtype=small), np.fromiter(map(len, rows), np.int64, len(rows)))[dark]
    pair, side, grams, bounds = text >> 1, text & 1, codes, np.arange(pairs + 1, dtype=small)
    for n in range(len(out)):
        if n:
            if pairs.bit_length() + width + bits > 62:  # grams are numbered, where they take too many bits
                kinds, grams = np.unique(grams, return_inverse=True)
                width = len(kinds).bit_length()
            grams, width = grams[:-1] << bits | codes[n:], width + bits
        keys = pair[: len(grams)] << (width + 1) | grams << 1 | side[: len(grams)]
        keys = np.sort(keys[text[: len(grams)] == text[n:]])
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        ends = np.searchsorted(keys, bounds << (width + 1))
        second, both = (np.append(0, np.cumsum(k))[ends] for k in (keys & 1, np.append(keys[1:] >> 1 == keys[:-1] >> 1, False)[: len(keys)]))
        every, second, both = (np.diff(k) for k in (ends, second, both))
        out[n] = every - second, second, both


def _chrf(order: int, beta: float):
    @F.arrow_udf(DoubleType())
    def score(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        x, y, same = gram_counts(reference, hypothesis, order).astype(float).swapaxes(0, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            p, r = same / y, same / x
            scores = np.nan_to_num((1 + beta**2) * p * r / (beta**2 * p + r), nan=0.0)  # 0 without grams, or common ones
        return pa.array(sum(scores[1:], scores[0]) / order)

    return score


def with_chrf(df: DataFrame, reference: str, hypothesis: str, name: str = "chrf", order: int = 3, beta: float = 2.0) -> DataFrame:
    """A lexical stand-in for a learned translation metric: F-score over distinct character n-grams up to ``order``."""
    return df.withColumn(name, _chrf(order, beta)(F.col(reference), F.col(hypothesis)))
