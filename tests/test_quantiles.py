import math
import random

from pyspark.sql import functions as F

from quorumlens.operators import quantiles
from quorumlens.operators.quantiles import exact_percentiles

WANTED = {"least": 0.0, "p1": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99, "most": 1.0}


def plain(values, q):
    values, at = sorted(values), q * (len(values) - 1)
    lo, hi = values[math.floor(at)], values[math.ceil(at)]
    return lo if math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi


def data():
    r = random.Random(1)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [1.0] * 500 + [2.0] * 3, None: [r.gauss(0, 1) for _ in range(100)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(4000)],
              "whole": [float(r.randrange(7)) for _ in range(3000)], "negative": [-r.random() for _ in range(777)]}
    return groups


def check(got, groups):
    assert {x.g for x in got} == {g for g, v in groups.items() if v}
    for x in got:
        assert x.n == len(groups[x.g])
        for name, q in WANTED.items():
            assert math.isclose(x[name], plain(groups[x.g], q), rel_tol=1e-12, abs_tol=0), (x.g, name)


def test_equal_to_sorting(spark, monkeypatch):
    groups = data()
    rows = [(g, v) for g, values in groups.items() for v in values] + [("empty", None), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for accuracy in (10_000, 20):  # the second has wide brackets
        check(exact_percentiles(df, ["g"], "v", WANTED, accuracy).collect(), groups)
    wrong = quantiles._at_ranks
    calls = []

    def first_misses(known, brackets, by):
        calls.append(1)
        return wrong(known, brackets.withColumns({"low": F.col("low") + 1e301, "high": F.col("high") + 1e301}) if len(calls) == 1 else brackets, by)

    monkeypatch.setattr(quantiles, "_at_ranks", first_misses)
    check(exact_percentiles(df, ["g"], "v", WANTED).collect(), groups)
    assert len(calls) == 2


def test_no_task_holds_a_group(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.xxhash64("id").cast("double").alias("v"))
    want = df.agg(F.percentile("v", [0.25, 0.5, 0.75])).first()[0]
    got = exact_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    assert [got.a, got.b, got.c] == want
    assert exact_percentiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0
