import hashlib
import math
import random
import re
import zlib

from quorumlens.llm.resample import block_buckets, ranked, resample, words_of
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(UPPER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(docs, target, percent, least, seed, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    long = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return out, long[: percent * len(long) // 100], gain


def rows():
    r = random.Random(3)
    word = lambda: r.choice(["Über", "the", "THE", "cat-fish", "x1", "don't", "日本", "a_b", "Z", "\x00", "é"])
    docs = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, " \t"), (903, "long " * 30_000), (904, "word"), (905, "Same text here " * 8), (905, "Same text here " * 8), (905, "another text " * 11), (None, "no id " * 15), (None, None)]
    return docs, ["the cat and the fish " * 5, "日本 x1", None, ""]


def test_equal_to_plain_python(spark):
    docs, target = rows()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, packed string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, least, seed, buckets in ((25, 20, 7, 10_000), (50, 0, 8, 17)):
        out, drawn, _ = plain(docs, target, percent, least, seed, buckets)
        got = resample(table, wanted, percent=percent, min_words=least, seed=seed, buckets=buckets).collect()
        key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
        assert sorted(([x.doc_id, x.n_words, x.n_features, x.weight, x.score] for x in got), key=key) == sorted(out, key=key)
        placed = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
        assert [x["rank"] for x in placed] == list(range(1, len(drawn) + 1))
        assert [(x.score, x.doc_id) for x in placed] == [(x[4], x[0]) for x in drawn]


def test_empty_tables(spark):
    docs, target = rows()
    none, table = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert resample(none, table.select("text")).count() == 0
    out, drawn, _ = plain(docs, [], 25, 20, 7, 10_000)
    got = resample(table, none.select("text")).collect()
    assert sorted(x.weight for x in got) == sorted(x[3] for x in out)
    assert sum(x["rank"] is not None for x in got) == len(drawn)


def test_blocks_and_ranks(spark):
    r = random.Random(5)
    texts = [words_of(" ".join(r.choice("ab cd ef g".split()) for _ in range(r.randrange(6)))) for _ in range(50)]
    for words, found in zip(texts, block_buckets(texts, 1000)):
        both = words + [a + b" " + b for a, b in zip(words, words[1:])]
        assert found.tolist() == [zlib.crc32(f) % 1000 for f in both]
    same = ranked(spark.range(1000).select(F.lit(1).alias("k")), F.asc("k"))
    assert sorted(x["rank"] for x in same.collect()) == list(range(1, 1001))
    assert ranked(spark.range(0).select(F.lit(1).alias("k")), F.asc("k")).count() == 0
