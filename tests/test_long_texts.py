import random
import time
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlens.functions import similarity
from quorumlens.functions.similarity import with_chrf, word_distance
from quorumlens.operators import metrics
from tests.test_operators import distance


def test_word_distance_equals_the_table(monkeypatch):
    r = random.Random(1)
    for bits in (1, 3, 64, 8192):
        monkeypatch.setattr(similarity, "BITS", bits)
        for _ in range(150):
            a, b = (r.choices("abcd" if r.random() < 0.7 else [f"w{k}" for k in range(50)], k=r.randrange(25)) for _ in range(2))
            if r.random() < 0.4:
                b = [x for x in a if r.random() < 0.9]
            assert word_distance(a, b) == distance(a, b), (a, b)


def test_36000_different_words_take_seconds():
    r = random.Random(2)
    a = [f"word{k}" for k in range(36_000)]
    b = [x if r.random() < 0.5 else f"other{k}" for k, x in enumerate(a) if k % 11]
    began = time.process_time()
    far = word_distance(a, b)
    assert time.process_time() - began < 2.8
    assert far == sum(1 for k, x in enumerate(a) if k % 11 == 0) + sum(x.startswith("other") for x in b)


def test_both_ways_agree(spark):
    r = random.Random(3)
    make = lambda n: " ".join(r.choices("a b c dd e'e f".split(), k=n))
    rows = [(k, "s", x, y) for k, (x, y) in enumerate([(make(r.randrange(9)), make(r.randrange(9))) for _ in range(200)] + [(make(900), make(800)), (None, None), ("", "a")])]
    df = spark.createDataFrame(rows, "id long, service string, human string, service_output string")
    assert sorted(metrics.word_error_rows(df).collect()) == sorted(metrics.word_error_rows(df, long=True).collect())


def plain_chrf(x, y, order=3, beta=2.0):
    x, y = "".join((x or "").split()), "".join((y or "").split())
    total = 0.0
    for n in range(1, order + 1):
        a, b = ({t[k : k + n] for k in range(len(t) - n + 1)} for t in (x, y))
        if a and b and a & b:
            p, q = len(a & b) / len(b), len(a & b) / len(a)
            total += (1 + beta**2) * p * q / (beta**2 * p + q)
    return total / order


def test_chrf_equals_plain_python(spark):
    r = random.Random(4)
    make = lambda: r.choice([None, "", " ", "a", "ab", "Ünï cödé", "".join(r.choices("abc d", k=r.randrange(30)))])
    pairs = [(make(), make()) for _ in range(300)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "id long, reference string, hypothesis string")
    got = {x.id: x.chrf for x in with_chrf(df, "reference", "hypothesis").collect()}
    assert all(abs(got[k] - plain_chrf(x, y)) < 1e-12 for k, (x, y) in enumerate(pairs))


def test_blocks_of_long_texts_equal_the_standard_library(spark):
    r = random.Random(5)
    base = "".join(r.choices("abcdefgh ijklmnop", k=3000))
    texts = []
    for _ in range(12):
        t = list(base)
        for _ in range(r.randrange(200)):
            t[r.randrange(len(t))] = r.choice("xyz ")
        texts.append("".join(t)[r.randrange(300) :])
    got = similarity.match_ratios(texts[:-1], texts[1:])
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in zip(texts, texts[1:])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert df.select(similarity.matching_ratio(F.col("t"), F.col("t")).alias("x")).distinct().collect() == [(1.0,)]


@pytest.mark.parametrize("together", [40, 1 << 17])
def test_grams_of_many_pairs_are_those_of_sets(monkeypatch, together):
    """grams are counted by sorting the numbers of many pairs, not by lists of substrings of each row."""
    r, found = random.Random(5), []
    monkeypatch.setattr(similarity, "CHARACTERS", together)
    alphabets = ["ab ", "abcdefgh \n", "".join(map(chr, range(1, 400))), "é漢😀a \xa0 b"]
    pairs = [tuple(None if r.random() < 0.05 else "".join(r.choices(r.choice(alphabets), k=r.choice([0, 1, 2, 3, 30, 90]))) for _ in "xy") for _ in range(300)]
    for x, y in pairs:
        x, y = ("".join(c for c in t or "" if c not in " \t\n\x0b\f\r") for t in (x, y))
        sets = [[{t[i : i + n] for i in range(len(t) - n + 1)} for t in (x, y)] for n in range(1, 10)]
        found.append([[len(a), len(b), len(a & b)] for a, b in sets])
    for order in (1, 3, 9):
        got = similarity.gram_counts(*(pa.array([p[k] for p in pairs]) for k in (0, 1)), order)
        assert got.transpose(2, 0, 1).tolist() == [f[:order] for f in found]


def test_chrf_builds_no_lists_of_substrings(spark):
    df = spark.createDataFrame([("a b", "b a")], "reference string, hypothesis string")
    assert "transform(" not in with_chrf(df, "reference", "hypothesis")._jdf.queryExecution().optimizedPlan().toString()


def test_long_pairs_are_counted_side_by_side(monkeypatch):
    """pairs of all lengths in one number, and those beyond it, equal the table."""
    r, words = random.Random(3), pa.list_(pa.string())
    pairs = [([], []), ([], ["a"]), (["a", "b"], []), (["a"], ["a"]), (None, ["a"])]
    for _ in range(150):
        vocabulary = [f"w{k}" for k in range(r.choice([1, 2, 9, 400]))]
        a = r.choices(vocabulary, k=r.choice([1, 7, 8, 9, 63, 64, 65, 120]))
        pairs.append((a, [w for w in a if r.random() < 0.8] if r.random() < 0.5 else r.choices(vocabulary, k=r.randrange(130))))
    want = [distance(a or [], b) for a, b in pairs]
    for packed, alone in ((1 << 14, 1 << 12), (200, 1 << 12), (1, 1), (300, 64)):
        monkeypatch.setattr(similarity, "PACKED", packed)
        monkeypatch.setattr(similarity, "ALONE", alone)
        for sides in ((0, 1), (1, 0)):
            assert similarity.long_distances(*(pa.array([p[k] for p in pairs], words) for k in sides)).tolist() == want
