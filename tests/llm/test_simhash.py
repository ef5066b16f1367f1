import random

import xxhash
from pyspark.sql import functions as F

from quorumlens.llm.components import connected_components
from quorumlens.llm.simhash import crowded_keys, distance_bound, fingerprint, hamming_components, hamming_links, near_dedup, near_duplicate_groups, near_links, similar_links


def plain(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, links):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50, 400]:
        t = "".join(r.choice(["É", "A", "b", "ü\xa0x"]) + r.choice([" ", "\t ", "\n"]) for _ in range(n))
        assert fingerprint(t, 3)[0] % 2**64 == plain(t, 3)


def test_components_equal_brute_force_with_and_without_crowded_buckets(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = sorted({b ^ sum(1 << i for i in set(r.choices(range(64), k=r.randint(0, 5)))) for b in base for _ in range(12)} | {base[0] ^ 1 << i ^ 1 << j for i in range(20) for j in range(i)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for bits in (0, 1, 2):
        want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits])
        for bucket in (3, 10_000):
            links = hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, bucket)
            parts = dict(connected_components(links).collect())
            of = [parts.get(f, f) for f in signed]
            assert len(set(zip(of, want))) == len(set(of)) == len(set(want))


def test_rows(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words), (2, words.upper()), (3, None), (0, " \n"), (5, "x"), (None, words), (5, "x"), (9, "other words of its own here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted((str(x["doc_id"]), x["component_id"]) for x in hamming_components(docs).collect())
    assert got == sorted([("1", 1), ("2", 1), ("3", 0), ("0", 0), ("5", 5), ("None", 1), ("5", 5), ("9", 9)])
    assert hamming_components(docs.filter("doc_id > 99")).count() == 0


def test_near_duplicates(spark):
    r = random.Random(3)
    rows = []
    for g in range(60):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(250)]
        rows.append((10 * g, " ".join(words)))
        for c in (1, 2, 3):
            copy = list(words)
            copy[r.randrange(250)] = "changed"
            copy[r.randrange(250)] = "again"
            rows.append((10 * g + c, " ".join(copy)))
    rows += [(5000 + i, " ".join(f"v{r.randint(0, 10**6)}" for _ in range(100))) for i in range(200)] + [(None, "no id"), (7777, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, group_id int").drop("group_id")
    got = {x["doc_id"]: x["group_id"] for x in near_duplicate_groups(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == i for i, _ in rows if i and i >= 5000)
    joined = [got[10 * g + c] == 10 * g for g in range(60) for c in (1, 2, 3)]
    assert sum(joined) >= 0.95 * len(joined)
    assert near_duplicate_groups(docs.filter("doc_id < 0")).count() == 0


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(r, words, edits):
    copy = list(words)
    for at in r.sample(range(len(words)), edits):
        copy[at] = f"x{r.randint(0, 10**6)}"
    return " ".join(copy)


def test_groups_are_those_of_exact_similarities(spark):
    """Families around the threshold: no link below 0.8, and nearly all from there on."""
    r, rows = random.Random(8), []
    for _ in range(50):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(r.choice([40, 120, 300]))]
        rows += [edited(r, words, e) for e in (0, 0, 1, 2, len(words) // 40, len(words) // 30, len(words) // 20)]
    rows += ["one two three four five", "One two three four five", "one two", "", None, "a b c d e f", "a b c d e f g"]
    texts = dict(enumerate(rows))
    links = [(a, b) for a in texts for b in range(a) if a - b < 8 and similar(texts[a], texts[b]) >= 0.8]
    want = groups(len(rows), links)
    got = {x["doc_id"]: x["group_id"] for x in near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(want[i] == want[g] for i, g in got.items())  # no document is grouped that shouldn't be
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    assert got[len(rows) - 6] == len(rows) - 7 and got[len(rows) - 3] == len(rows) - 4 and got[len(rows) - 2] == len(rows) - 2


def test_similar_links_equal_brute_force_whatever_the_tile(spark):
    r = random.Random(13)
    words = [f"w{i}" for i in range(60)]
    texts = [edited(r, words, r.randint(0, 4)) for _ in range(60)]
    want = groups(60, [(a, b) for a in range(60) for b in range(a) if a % 2 == b % 2 and similar(texts[a], texts[b]) >= 0.7])
    df = spark.createDataFrame([(i, i % 2, t, 0) for i, t in enumerate(texts)], "id long, key long, text string, f0 long")
    for tile in (60, 500, 1 << 20):
        parts = dict(connected_components(similar_links(df, 64, 0.7, 5, tile)).collect())
        assert [parts.get(i, i) for i in range(60)] == want


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, words, 7), (2, words + " end", 7), (2, "quite another text of its own", 8), (None, words + " fin", 9), (None, "alone without id", 9), (3, "", 1), (4, None, 1), (1, words, 7), (5, "x y z " * 30_000, 2)]
    rows += [(None, "twice " * 60 + "a", 3), (None, "twice " * 60 + "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id int")
    docs = docs.withColumns({"hash": F.lit("h"), "member_doc_id": F.lit(1), "F0": F.lit(2), "best": F.lit(False)})
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "", x["group_id"]) for x in kept.collect()))
    assert [g[1:] for g in got] == [(1, words, 7), (2, "quite another text of its own", 8), (3, "", 1), (5, "x y z " * 30_000, 2), (0, "alone without id", 9), (0, "twice " * 60 + "a", 3)]
    out = near_duplicate_groups(docs)
    assert out.columns == [*docs.columns, "_group_id"] and out.count() == len(rows)
    assert near_dedup(docs.limit(0)).count() == 0


def test_crowded_keys(spark):
    r = random.Random(4)
    near = [r.getrandbits(6) for _ in range(300)]
    rows = [(i, v | 5 << 32) for i, v in enumerate(near)] + [(1000 + i, r.getrandbits(63)) for i in range(300)]
    got = {x["key"]: x["n"] for x in crowded_keys(spark.createDataFrame(rows, "id long, f0 long"), ["f0"], 40).collect()}
    members = {}
    for _, f in rows:
        for k, v in enumerate((f & 0xFFFFFFFF, f >> 32)):
            for x in [v] + [v ^ 1 << b for b in range(32)]:
                members[x | k << 32] = members.get(x | k << 32, 0) + 1
    assert {k for k, n in members.items() if n > 40} <= set(got) and all(n >= members.get(k, 0) for k, n in got.items())


def test_near_links_equal_brute_force_whatever_the_tile(spark):
    r = random.Random(11)
    flip = lambda f, most: f ^ sum(1 << i for i in set(r.choices(range(128), k=r.randint(0, most))))
    prints = list({flip(b, 24) for b in [r.getrandbits(128) for _ in range(5)] for _ in range(60)})
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = [(i, signed(f % 2**64), signed(f >> 64)) for i, f in enumerate(prints)]
    meets = lambda x: any((x >> 32 * k & 0xFFFFFFFF).bit_count() <= 2 for k in range(4))
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (x := prints[i] ^ prints[j]).bit_count() <= 19 and meets(x)])
    assert len(set(want)) < len(want)
    for tile in (3, 20, 4096):
        links = near_links(spark.createDataFrame(rows, "id long, f0 long, f1 long"), 19, tile)
        parts = dict(connected_components(links).collect())
        assert [parts.get(i, i) for i in range(len(prints))] == want


def test_index_columns_make_the_buckets_and_the_others_verify(spark):
    r = random.Random(12)
    flip = lambda f, bits, most: f ^ sum(1 << i for i in set(r.choices(range(bits), k=r.randint(0, most))))
    base = [(r.getrandbits(64), r.getrandbits(128)) for _ in range(6)]
    prints = list({(flip(i, 64, 8), flip(f, 128, 20)) for i, f in base for _ in range(40)})
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = [(n, signed(i), signed(f % 2**64), signed(f >> 64)) for n, (i, f) in enumerate(prints)]
    meets = lambda x: any((x >> 32 * k & 0xFFFFFFFF).bit_count() <= 2 for k in range(2))
    near = lambda a, b: (a[1] ^ b[1]).bit_count() <= 15 and meets(a[0] ^ b[0])
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if near(prints[i], prints[j])])
    links = near_links(spark.createDataFrame(rows, "id long, i0 long, f0 long, f1 long"), 15, 16, ["i0"])
    parts = dict(connected_components(links).collect())
    assert [parts.get(i, i) for i in range(len(prints))] == want


def test_copies_close_to_the_threshold(spark):
    """Four scattered words of 250: a similarity of 0.85. Forty: below 0.2."""
    r, rows = random.Random(5), []
    for g in range(120):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(250)]
        for c, edits in enumerate((0, 4, 40)):
            copy = list(words)
            for at in r.sample(range(250), edits):
                copy[at] = f"x{r.randint(0, 10**6)}"
            rows.append((3 * g + c, " ".join(copy)))
    got = {x["doc_id"]: x["group_id"] for x in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[3 * g + 1] == 3 * g for g in range(120)) >= 110
    assert all(got[3 * g + 2] == 3 * g + 2 for g in range(120))


def test_bound():
    assert 18 <= distance_bound(0.8, 128) <= 20 and 28 <= distance_bound(0.8) <= 30 and distance_bound(1.0) == 0
