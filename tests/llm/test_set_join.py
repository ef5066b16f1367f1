import itertools
import random

import numpy as np
import pytest

from quorumlens.llm import set_join
from quorumlens.llm.queries import op13_set_join
from quorumlens.llm.set_join import jaccard_components, light_boundary, light_links, named_sets, need, packed_sets, set_nodes, subset_rows

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, shingle=5):
    words = (text or "").translate(UPPER).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1)))


def plain(rows, percent=80, shingle=5):
    """(doc_id, n_shingles, component_id) of each row, all pairs compared."""
    sets = [plain_set(t, shingle) for _, t in rows]
    different = {}
    for k, s in enumerate(sets):
        different.setdefault(s, k)
    parent = {s: s for s in different}

    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    links = set()
    for a, b in itertools.combinations([s for s in different if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            links.add((different[a], different[b]))
            parent[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return sorted(((str(i), len(s), str(least.get(find(s)) if s else i)) for (i, _), s in zip(rows, sets))), links


def corpus(seed=1, bases=12, copies=12, sizes=(1, 3, 5, 6, 8, 9, 12, 14, 20, 30, 60, 150)):
    """Families of edited copies of all sizes, texts made of shared passages, equal and blank texts."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrs")
    passage = [word() for _ in range(60)]
    rows = []
    for base in range(bases):
        words = [word() for _ in range(sizes[base % len(sizes)])]
        for _ in range(copies):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [word()], [w[at], word()]])
                w = w or [word()]
            if r.random() < 0.2:
                w = passage + w
            rows.append(r.choice([" ", "\n", "  ", "\t"]).join(x.upper() if r.random() < 0.1 else x for x in w))
    rows += [" ".join(passage + [word() for _ in range(r.randrange(5, 30))]) for _ in range(30)]
    rows += ["", None, " \n", "one", "ONE", "same text", "same text", "Ünï Ünï", "ünï ünï", "x " * 400]
    r.shuffle(rows)
    out = list(enumerate(rows, 100))
    return out + [(100, rows[0]), (100, "other text under a known id"), (None, rows[1]), (None, "alone without id"), (None, None)]


def got(df):
    return sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in df.collect())


@pytest.mark.parametrize("percent", [80, 60])
def test_equal_to_all_pairs(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, shingle string").repartition(5)
    want, links = plain(rows, percent)
    assert len(links) > 100
    assert got(jaccard_components(docs, percent=percent)) == want


def test_all_light_all_heavy_and_small_tiles(spark, monkeypatch):
    rows = corpus(seed=2, bases=8, sizes=(5, 6, 8, 9, 10, 12, 14, 40))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = plain(rows)
    monkeypatch.setattr(set_join, "BLOCK", 40)
    monkeypatch.setattr(set_join, "RANGE", 300)
    monkeypatch.setattr(set_join, "TILE", 3)
    for light, few in ((0, 100_000), (10, 0)):
        monkeypatch.setattr(set_join, "light_boundary", lambda *_: light)
        monkeypatch.setattr(set_join, "FEW", few)
        monkeypatch.setattr(set_join, "NARROW", 1 if few else 1 << 15)  # whole shingles, and their lower bits
        assert got(jaccard_components(docs)) == want


def test_query_on_a_large_group(spark, tmp_path):
    r = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(1300):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(60)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, "the same words in each of these rows") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(op13_set_join(spark, str(tmp_path))) == plain(rows)[0]


def test_empty_tables_and_limits(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert got(jaccard_components(blank)) == [("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3")]
    with pytest.raises(ValueError):
        jaccard_components(none, percent=30)


def test_needed_shingles_and_subsets(spark):
    for percent in (50, 80, 93, 100):
        for n in range(1, 30):
            for m in range(1, 30):
                k = need(n, m, percent)
                assert 100 * k >= percent * (n + m - k) and 100 * (k - 1) < percent * (n + m - k + 1)
    assert subset_rows(4, 80) == 2  # itself for partners of four and of five
    texts = [(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k x"), (3, "y b c d e f g h i j k z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = set_nodes(named_sets(docs, "text", "doc_id", 5))
    nodes = {x.id: x.first_id for x in made.collect()}
    links = light_links(packed_sets(docs, "text", "doc_id", 5, made), 75)
    assert {tuple(sorted((nodes[x.a], nodes[x.b]))) for x in links.collect()} == {(1, 2), (2, 3)} & {(a, b) for a, b in ((1, 2), (2, 3), (1, 3)) if len(plain_set(texts[a - 1][1]) & plain_set(texts[b - 1][1])) >= need(8, 8, 75)}
    assert light_boundary({}, 80) == 20 and light_boundary({4: 1000, 12: 5}, 80) >= 4 and light_boundary({12: 1000, 20: 5000}, 80) < 12
    assert np.unique(set_join.shingle_set("a a a a a a a", 5)).size == 1
