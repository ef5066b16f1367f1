import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorumlens.llm import token_shards
from quorumlens.llm.token_shards import Grammar, WordEncoder, read_documents, repair, rule_lengths, with_starts, write_shards

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(1)
    for vocabulary, n in ((2, 5000), (50, 20_000), (50_000, 300), (1, 4001)):
        ids = r.integers(0, vocabulary, n).astype(np.uint32)
        ends = np.unique(np.append(r.integers(1, n, 30), n))
        symbols, stops, rules = repair(ids, ends, 1 << 16, per_round=64, least=2)
        g = Grammar(1 << 16, rules, rule_lengths(rules, 1 << 16))
        assert (g.expand(symbols) == ids).all() and len(stops) == len(ends)
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            doc = symbols[stops[k - 1] if k else 0 : stops[k]]
            assert (g.expand(doc) == ids[a:b]).all()
            lo, hi = sorted(r.integers(0, b - a + 1, 2))
            assert (g.slice(doc, lo, hi) == ids[a:b][lo:hi]).all()
        assert vocabulary > 100 or len(symbols) < 0.9 * n


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(3)
    passage = r.integers(0, 40_000, 400)
    ids = np.concatenate([x for _ in range(6) for x in (passage, r.integers(0, 40_000, 50))] + [np.full(37, 5)]).astype(np.uint32)
    symbols, stops, rules = repair(ids, np.array([900, len(ids)]), 1 << 16)
    lengths = rule_lengths(rules, 1 << 16)
    assert (Grammar(1 << 16, rules, lengths).expand(symbols) == ids).all() and lengths.max() >= 200
    pairs = [(a, b) for lo, hi in ((0, stops[0]), (stops[0], stops[1])) for a, b in zip(symbols[lo:hi].tolist(), symbols[lo + 1 : hi].tolist())]
    assert max(pairs.count(p) for p in pairs if p[0] != p[1]) < 4


def test_rounds_of_any_size_leave_no_frequent_pair():
    r = np.random.default_rng(6)
    for trial in range(6):
        ids = np.concatenate([r.integers(0, 6 + 5 * trial, 1500), np.tile(r.integers(0, 9, 40), 12), np.zeros(31)]).astype(np.uint32)
        ends = np.unique(np.append(r.integers(1, len(ids), 9), len(ids)))
        for per_round in (1, 5, 10_000):
            symbols, stops, rules = repair(ids, ends, 1 << 16, per_round)
            g = Grammar(1 << 16, rules, rule_lengths(rules, 1 << 16))
            assert (g.expand(symbols) == ids).all() and (np.cumsum(g.sizes(symbols.astype(np.int64)))[stops - 1] == ends).all()
            inner = [(a, b) for k, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist())) if k + 1 not in stops and a != b]
            assert max(map(inner.count, set(inner)), default=0) < 4
    assert [len(x) for x in repair(np.empty(0, np.uint32), np.empty(0, np.int64), 1 << 16)] == [0, 0, 0]


def texts():
    r = random.Random(4)
    parts = ["the", " The", "TION", "é", "É", "ß", "²", "\xa0", "\x85", "  ", "\n", "don't", "'LL", "'s", "<|endoftext|>", "😀", "日本", "123", "_", "!!", "***", "Σ", "ΑΣ", "İ", "é", "</w>", "ŉ", "ǰ", "ſ", "K", "Å", "\x1c", "<|ENDOFTEXT|>", " ", "a_b", "x1y2", "\u2028"]
    return ["", "x" * 5000, " \n "] + ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(1500)]


def test_encoder_equals_the_library():
    library, own = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for t, ids in zip(texts(), own.encode(texts()), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_files(spark, tmp_path):
    library, r = Tokenizer.from_file(PATH), random.Random(2)
    rows = [(r.randint(-50, 10**9), t) for t in texts()[:400]] + [(7, "b"), (7, "a"), (7, "a"), (8, None), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(5)
    write_shards(docs, PATH, str(tmp_path / "shards"), shard_ids=700)
    shards = spark.read.parquet(str(tmp_path / "shards"))
    assert shards.count() > 5
    got = with_starts(read_documents(shards), shards).orderBy("start").collect()
    start = 0
    for x, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (x["doc_id"], x["start"]) == (i, start) and np.frombuffer(x["ids"], "<u4").tolist() == ids
        start += len(ids)
    got = with_starts(read_documents(shards), shards).select(F.crc32("ids").alias("c"), "ids").first()
    assert got["c"] == zlib.crc32(bytes(got["ids"]))


def test_empty(spark, tmp_path):
    write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH, str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    assert with_starts(read_documents(none), none).count() == 0


class Counted:
    """A tokenizer that counts the words it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, 0

    def encode(self, text, **options):
        self.words += len(text.split())
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.words += sum(len(t.split()) for t in texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_the_library_gets_each_piece_once():
    library, own, r = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(8)
    counted = [Counted(t) for t in vars(own).values() if isinstance(t, Tokenizer)]
    for name in [k for k, t in vars(own).items() if isinstance(t, Tokenizer)]:
        setattr(own, name, next(c for c in counted if c.tokenizer is getattr(own, name)))
    stems, marks = ["".join(r.choices("aeiourstlé", k=7)) for _ in range(200)], [".", ",", "!", "?", ";", "...", ")", "'s", ":", "%%"]
    for _ in range(3):
        some = [" ".join(r.choice(stems) + r.choice(marks) + r.choice(["", "", r.choice(marks)]) for _ in range(400)) for _ in range(10)]
        for t, ids in zip(some, own.encode(some), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert sum(c.words for c in counted) <= 200 + 10 + 10 * 10  # stems, marks, and marks that run together


def test_encoder_forgets_and_takes_any_latin_character(monkeypatch):
    monkeypatch.setattr(token_shards, "REMEMBERED", 60)
    library, own, r = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(9)
    latin = [chr(i) for i in range(0x2B0)] + list("\u0301\u1680\u1e9e\u2003\u2028\u202f\u205f\u3000\u212a\u212b\ufeff")
    some = [f"{c} x{c}y{c}{c}1{c}.\n" for c in latin] + ["".join(r.choices(latin, k=9)) for _ in range(2000)]
    for at in range(0, len(some), 100):
        part = some[at : at + 100]
        for t, ids in zip(part, own.encode(part), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)
    assert [x.tolist() for x in own.encode([])] == [] and len(own.pieces) < 600


def test_pairs_that_do_not_fit_one_number_are_grouped_alike():
    r = np.random.default_rng(5)
    first, second = r.integers(0, 40, (2, 3000)).astype(np.uint64)
    for a, b in zip(token_shards._same_pairs(first, second, 1 << 16), token_shards._same_pairs(first, second, 1 << 31), strict=True):
        assert (a == b).all()


def test_batches_by_bytes(monkeypatch):
    monkeypatch.setattr(token_shards, "TOGETHER", 1000)
    r = random.Random(3)
    rows = [{"doc_id": i, "text": "y" * r.choice([0, 0, 5, 90, 5000])} for i in range(700)]
    batches = [pa.RecordBatch.from_pylist(rows[a:b], pa.schema([("doc_id", pa.int64()), ("text", pa.string())])) for a, b in ((0, 300), (300, 300), (300, 700))]
    got = [b.to_pylist() for b in token_shards._together(iter(batches))]
    assert [x for b in got for x in b] == rows and all(sum(len(x["text"]) + 64 for x in b[:-1]) < 1000 for b in got)
    assert len(got) < 400 and list(token_shards._together(iter(batches[1:2]))) == []
