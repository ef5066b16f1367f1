"""Byte-level BPE: encoding by merge ranks over a linked symbol list, decoding by concatenation.

The text is split by the tokenizer's pattern (its special tokens first). Each piece is a doubly linked list
of symbols, one for each byte; a heap holds the mergeable neighbours as (rank, left symbol, what the two were).
The lowest rank, leftmost first, is merged; entries whose symbols have changed since are stale and
skipped. A piece of n bytes takes O(n log n). Pieces recur, so each Python worker keeps what it has encoded
in a dictionary of bounded size. Ids travel as packed little-endian unsigned 32-bit integers.

Decoding concatenates the vocabulary's byte strings; bytes that are no UTF-8 become U+FFFD.

Defined results: null text is empty and has no ids; the text of a special token is that token; ids outside
the vocabulary are skipped when decoding, and null ids decode to the empty text.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from quorumlens.llm.common import by_slices, text_of

#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of common Latin characters only, where the faster module's classes mean the same.
LATIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
NOT_LATIN = re.compile("[^\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
#: Pieces that a worker remembers.
REMEMBERED = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def vocabulary_strings(spec: dict) -> dict[int, bytes]:
    """The bytes of each id."""
    to_byte = byte_alphabet()
    plain = {i: bytes(to_byte[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    return plain | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def decoded(ids: bytes, strings: dict[int, bytes]) -> str:
    """The concatenated strings of packed ids, as text."""
    return b"".join([strings.get(i, b"") for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


class ByteBpe:
    """A vocabulary file of the tokenizers library (byte-level BPE without normaliser)."""

    def __init__(self, path: str):
        spec = _spec(path)
        to_byte, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.byte_ids = {b: vocab[c] for c, b in to_byte.items()}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = vocabulary_strings(spec)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.latin, self.any = re.compile(LATIN_PATTERN), regex.compile(PATTERN)
        self.seen = _Seen(self)

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        pattern = self.any if NOT_LATIN.search(text) else self.latin
        return b"".join(map(self.seen.__getitem__, pattern.findall(text)))

    def decode(self, ids: bytes) -> str:
        return decoded(ids, self.strings)


class _Seen(dict):
    """Packed ids by piece, made when first asked for."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


@lru_cache(maxsize=1)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=1)
def _strings(path: str) -> dict[int, bytes]:
    return vocabulary_strings(_spec(path))


def encode(text: Column, path: str) -> Column:
    """The ids of a text column as packed little-endian unsigned 32-bit integers (binary)."""

    def make():
        bpe = _encoder(path)
        return lambda texts: [bpe.encode(t) for t in texts]

    return by_slices("binary", pa.binary(), make, text_of(text))


def decode(ids: Column, path: str) -> Column:
    """The text of packed ids."""

    def make():
        strings = _strings(path)
        return lambda packed: [decoded(x, strings) for x in packed]

    return by_slices("string", pa.string(), make, F.coalesce(ids, F.lit(b"")))


def round_trip(text: Column, path: str) -> Column:
    """struct<ids, decoded>: the ids of a text and their text, by one Python worker."""

    def make():
        bpe = _encoder(path)

        def both(texts: list[str]) -> list[dict]:
            ids = [bpe.encode(t) for t in texts]
            return [{"ids": x, "decoded": bpe.decode(x)} for x in ids]

        return both

    return by_slices("struct<ids: binary, decoded: string>", pa.struct([("ids", pa.binary()), ("decoded", pa.string())]), make, text_of(text))


def n_tokens(ids: Column) -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("long")
