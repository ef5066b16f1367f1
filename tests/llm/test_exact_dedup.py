import random
from collections import defaultdict

from pyspark.sql import functions as F

from quorumlens.llm.exact_dedup import duplicate_report, exact_dedup


def rows():
    r = random.Random(1)
    out = [(i, r.choice(["", None, "a", "b ", "b", "A", "long " * 2000])) for i in range(300)] + [(1000 + i, "hot") for i in range(1100)]
    return out + [(5, "same"), (5, "same"), (None, "alone"), (None, "a")]


def test_report_and_winners(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, digest string, salt int")
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    for digest in ({}, {"digest": lambda c: F.length(c).cast("string")}):
        report = duplicate_report(docs, salts=8, **digest).collect()
        assert len(report) == len(data)
        want = sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""])) for i, t in data)
        assert sorted((str(x["doc_id"]), str(x["keep_id"]), x["group_size"]) for x in report) == want
        assert sum(x["kept"] for x in report) == len(groups)
    kept = exact_dedup(docs).collect()
    assert exact_dedup(docs).columns == docs.columns
    assert sorted((x["text"] or "", str(x["doc_id"])) for x in kept) == sorted((t, str(max((x for x in g if x is not None), default=None))) for t, g in groups.items())


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert duplicate_report(empty).count() == 0 and exact_dedup(empty).count() == 0
