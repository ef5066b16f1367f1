import random
from collections import Counter

import numpy as np

from quorumlens.llm.decontaminate import NUMBER, OUTER, UNITS, Templates, Tokens, best_windows, bitmap_of, decontaminate, find_contamination, template


def plain(text):
    words, slots, begins, after_number = [], [], True, False
    for token in text.split():
        core = token.strip(OUTER)
        if not core:
            begins = begins or token[-1] in ".!?"
            continue
        number = NUMBER.fullmatch(core) is not None
        word = "<number>" if number else "<unit>" if after_number and core.lower() in UNITS else "<name>" if not begins and core[0].isupper() and not core.isupper() else core.lower()
        words.append(word)
        slots.append(core.lower() if word[0] == "<" else "")
        begins, after_number = token[-1] in ".!?:", number
    return words, slots


def test_many_texts_at_once_equal_one_by_one():
    r = random.Random(9)
    parts = ["Ana", "the", "km", "12", "3.5%", ".", "?", "-", "end.", "So:", "KM", "$5", "!", "Éva", "(x)", "7,"]
    texts = ["", " ", "."] + [" ".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(300)] + [""]
    made = Templates(texts, Tokens())
    for t, a, b in zip(texts, made.bounds, made.bounds[1:]):
        assert (made.words(a, b), made.slots(a, b)) == plain(t)


def test_template():
    words, slots = template("The train of Ana goes 120 km in 2 hours. Then Bob, too!")
    assert words == ["the", "train", "of", "<name>", "goes", "<number>", "<unit>", "in", "<number>", "<unit>", "then", "<name>", "too"]
    assert [s for s in slots if s] == ["ana", "120", "km", "2", "hours", "bob"]


ITEMS = [
    (1, "If Ana buys 12 apples and gives 5 apples to Bob then how many of the 12 apples does Ana still have left today?"),
    (2, "short item with five words"), (3, "tiny one"), (4, None), (5, " ".join(f"plain{i}" for i in range(60))), (6, "12 13 14 15 16 17 18 19 20 21"),
]


def test_found_and_left_alone(spark):
    r = random.Random(1)
    filler = lambda n: " ".join(f"x{r.randint(0, 9999)}" for _ in range(n))
    q = ITEMS[0][1]
    docs = [
        (1, f"{filler(30)} {q} {filler(30)}"),
        (2, f"{filler(30)}. {q.replace('12', '40').replace('Ana', 'Eve').replace('5', '7')} {filler(9)}"),  # re-parameterised
        (3, f"{filler(30)}. {q.replace('12 apples and', '40 apples and')} {filler(9)}"),  # 12 becomes 40 and 12: not consistent as a whole
        (4, f"{filler(5)} SHORT item with, five words {filler(5)}"), (5, "tiny one"), (6, None), (7, ""), (8, filler(2000)),
        (9, f"{filler(3)} {' '.join(f'plain{i}' for i in range(20, 40))} {filler(3)}"), (10, f"{filler(3)} {' '.join(f'plain{i}' for i in range(20, 30))} {filler(3)}"),
        (11, "12 13 14 15 16 17 18 19 20 21"), (1, f"{filler(30)} {q} {filler(30)}"), (None, q), (12, (f"{q} " * 500)),
        (13, f"{filler(4)} Short item with five words"),
    ]
    d = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, hash int, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = {(x["doc_id"], x["item_id"]): x["reworded"] for x in find_contamination(d, b).collect()}
    assert got == {(1, 1): False, (2, 1): True, (4, 2): False, (9, 5): False, (13, 2): False, (12, 1): False, (None, 1): False}
    kept = sorted(str(x["doc_id"]) for x in decontaminate(d, b).collect())
    assert kept == sorted(["3", "5", "6", "7", "8", "10", "11"])
    assert decontaminate(d, b).columns == d.columns


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(x["doc_id"], x["item_id"]): (x["covered_words"], x["reworded"]) for x in find_contamination(d, b, **options).collect()}


def test_one_slip_does_not_hide_a_copy(spark):
    q, loose = ITEMS[0][1], "the 12 of a or the 12 of b or the 12 of c or the 12 of d or the 12 of e"
    docs = [
        (1, q.replace("12 apples and", "40 apples and")),
        (2, q.replace("12", "40").replace("the 40", "the 41")),
        (3, loose.replace("12", "{}").format(1, 2, 3, 4, 5)),  # each window has two values for 12
        (4, q),
    ]
    got = found(spark, docs, [(1, q), (2, loose)], whole=True)
    assert got == {(1, 1): (20, False), (2, 1): (20, True), (4, 1): (24, False)}


def test_exact_copies_of_dense_and_short_items(spark):
    dense = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 and 16"
    items = [(1, dense), (2, "tiny one"), (3, "on 3 May 1901 Ann Lee met Bob Ray Max Poe Tim Fox Kim Dee Jo Ash"), (4, None), (5, "")]
    docs = [
        (1, f"so {dense} so"),
        (2, dense.replace("13", "99")),  # 12 words, then 4
        (3, "a tiny one, and a TINY one"),
        (4, "a tiny two"),
        (5, items[2][1].upper()),
        (6, "on 4 June 1902 Eve Roe met Cal Day Sam Low Ned Orr Pam Gee Al Ivy"),
    ]
    assert found(spark, docs, items, whole=True) == {(1, 1): (17, False), (3, 2): (2, False), (5, 3): (17, False)}


def test_names_that_begin_sentences_and_folded_case(spark):
    one, two = "Tom has 12 apples and gives 5 of them to his sister today.", "Tom has 5 apples. Ann has 3 pears. Kim has 9 plums. Who has most?"
    three = "We know that Ann Lee had 12 red apples and gave Bob Ray 5 of them today."
    docs = [
        (1, "Eve has 40 apples and gives 7 of them to his sister today."),
        (2, "Joe has 6 apples. Eve has 4 pears. Zoe has 1 plums. Who has most?"),
        (3, three.upper().replace("12", "30")),
        (4, three.lower().replace("5", "8")),
        (5, "eve has 40 apples and gives 7 of them to his sister today."),
        (6, "Eve has 40 pears and sells 7 of those to his brother today."),
    ]
    got = found(spark, docs, [(1, one), (2, two), (3, three)], whole=True)
    assert got == {(1, 1): (13, True), (2, 2): (15, True), (3, 3): (17, True), (4, 3): (17, True), (5, 1): (13, True)}


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_contamination(d.limit(0), b).count() == 0 and find_contamination(d, b.limit(0)).count() == 0
    assert find_contamination(d, b).count() == 1 and decontaminate(d, b.limit(0)).count() == 1


def test_large_benchmarks_and_windows_that_many_documents_hold(spark):
    """Sent to all or met over salts: the same result."""
    docs = spark.createDataFrame([(i, f"prefix{i} words here. {ITEMS[0][1]} suffix{i}") for i in range(1200)] + [(5000, ITEMS[4][1]), (5001, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for whole in (False, True):
        results = [sorted(map(tuple, find_contamination(docs, items, whole=whole, few=few).collect())) for few in (100_000, 0)]
        assert results[0] == results[1] and {r[0] for r in results[0]} == {*range(1200), 5000}


def test_bitmap_has_every_window_and_no_other(spark):
    r = random.Random(3)
    hashes = [r.getrandbits(64) - 2**63 for _ in range(500)]
    bits = bitmap_of(spark.createDataFrame([(h,) for h in hashes], "hash long"), 20)
    at = {(h % 2**64) >> 44 for h in hashes}
    assert len(bits) == 1 << 17 and {int(k) for k in np.flatnonzero(np.unpackbits(bits, bitorder="little"))} == at


def test_consistent_windows_equal_brute_force():
    """The longest run of windows that agree, or all that agree with the most frequent counterpart, by trying everything."""
    r = random.Random(21)
    for _ in range(400):
        n, size = r.randint(1, 7), 3
        places = sorted(r.sample(range(12), n))
        hits = [{"at": k, "pairs": [{"item_slots": r.choice("ab"), "slots": r.choice("xy")} for _ in range(r.randint(0, 2))]} for k in places]
        pairs = [[(p["item_slots"], p["slots"]) for p in h["pairs"]] for h in hits]
        agrees = lambda some: len({a for p in some for a, _ in p}) == len({q for p in some for q in p})
        cover = lambda ks: len({w for k in ks for w in range(places[k], places[k] + size)})
        best = max((cover(range(i, j)) for i in range(n) for j in range(i + 1, n + 1) if agrees(pairs[i:j])), default=0)
        votes = Counter(q for p in pairs for q in p)
        chosen = {}
        for a, b in sorted(votes, key=lambda q: (-votes[q], q[0] != q[1], q)):
            chosen.setdefault(a, b)
        best = max(best, cover([k for k in range(n) if all(chosen[a] == b for a, b in pairs[k])]))
        assert best_windows(hits, size)[0] == best


def test_texts_under_one_id_and_without_any_are_judged_apart(spark):
    leak = "seven old sailors repair the broken mast with tar and rope before the storm reaches the northern harbour at night"
    words = leak.split()
    first, second = " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])
    rows = [(4, "a clean text that stays"), (4, f"here {leak} there"), (9, f"start {first} of one"), (9, f"other text {second} end"), (10, f"start {first} of one"), (11, f"other text {second} end"),
            (None, leak), (None, "clean and without id"), (None, None), (2**60 + 1, leak), (12, f"twice {leak}"), (12, f"twice {leak}")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, text_hash int").repartition(3)
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    for few in (100_000, 0):
        kept = sorted(((x["doc_id"] or 0, x["text"] or "", x["text_hash"]) for x in decontaminate(docs, items, whole=True, few=few).collect()))
        assert kept == sorted((i or 0, t or "", 1) for i, t in rows if leak not in (t or ""))
        found = sorted(((x["doc_id"] or 0, x["item_id"]) for x in find_contamination(docs, items, whole=True, few=few).collect()))
        assert found == [(0, 1), (4, 1), (12, 1), (2**60 + 1, 1)]
