import random

import numpy as np
from pyspark.sql import functions as F

from quorumlens.llm.quality import FactorisationMachine, fit_quality, platt, quality_score
from quorumlens.llm.sparse import Rows
from quorumlens.llm.toxicity import fit_nnpu, fit_toxicity, risks, slopes, toxicity_score


def auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    return float(np.mean(pos[:, None] > neg[None, :]))


def test_linear_time_form_equals_all_pairs():
    r = np.random.default_rng(1)
    m = FactorisationMachine(30, 4)
    m.w, m.w0 = r.normal(size=30), 0.3
    index, value = np.sort(r.choice(30, 9, replace=False)), r.normal(size=9)
    pairs = sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(9) for b in range(a))
    raw = m.w0 + m.w[index] @ value + pairs
    assert abs(m.score(index, value) - 1 / (1 + np.exp(-raw))) < 1e-12
    both, _ = m.parts(np.tile(index, 2), np.tile(value, 2), np.repeat([0, 1], 9), 2)
    assert np.allclose(both, raw)


def test_factors_learn_an_interaction():
    r = np.random.default_rng(2)
    bits = r.integers(0, 2, (1500, 2))
    rows = Rows([(np.array([0 + b[0], 2 + b[1]]), np.ones(2)) for b in bits])
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    m = FactorisationMachine(4, 4)
    m.fit(rows, y, epochs=40)
    assert auc(np.array([m.score(rows.index[2 * i : 2 * i + 2], np.ones(2)) for i in range(1500)]), y) > 0.95


def corpus(n=600):
    r = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 5 == 0
        tokens = r.choices(words, k=r.randint(20, 80))
        if bad:
            tokens = [t.upper() + "!!" for t in tokens[:10]] * 4
        elif toxic:
            tokens[3:3] = [r.choice(["vileword", "nastyword"]), "vileness"]
        rows.append((i, " ".join(tokens), len(" ".join(tokens)), int(not bad), int(toxic and not bad)))
    return rows


def test_quality(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, n_chars long, quality int, toxic int")
    machine = fit_quality(docs.filter("doc_id % 4 <> 0"))
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", 0, 1, 0), (-3, "z" * 10**6, 5, 1, 0)], docs.schema)
    every = docs.unionByName(odd)
    out = every.select("doc_id", "quality", quality_score(every, machine).alias("score")).toPandas()
    assert len(out) == 603 and out["score"].between(0, 1).all()
    held = out[(out.doc_id % 4 == 0) & (out.doc_id >= 0)]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.99
    one = fit_quality(docs.filter("quality = 1"))
    assert docs.select(quality_score(docs, one).alias("s")).agg(F.min("s")).first()[0] > 0.9


def test_toxicity(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, n_chars long, quality int, toxic int")
    learn = docs.filter("doc_id % 4 <> 2")
    model = fit_toxicity(learn.select("doc_id", "text"), learn.filter("doc_id % 3 <> 0").select("doc_id", "toxic"), prior=0.13)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "z" * 10**6)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    out = every.select("doc_id", toxicity_score(every, model).alias("score")).toPandas().merge(docs.toPandas(), "left", on="doc_id")
    held = out[(out.doc_id % 4 == 2) & (out.doc_id >= 0)]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.97
    assert len(out) == 603 and (out.score[out.doc_id < 0] < 0.3).all()
    none = fit_toxicity(learn.select("doc_id", "text"), learn.limit(0).select("doc_id", "toxic"))
    assert docs.select(toxicity_score(docs, none).alias("s")).agg(F.max("s")).first()[0] < 1e-9


def test_toxicity_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, n_chars long, quality int, toxic int").select("doc_id", "text", "toxic")
    extra = spark.createDataFrame([(1, "another text under a known id", 0), (None, "no id", 1)], docs.schema)
    docs = docs.unionByName(extra)
    models = [fit_toxicity(d.select("doc_id", "text"), d.select("doc_id", "toxic")) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy("text"))]
    for w, b in models[1:]:
        assert b == models[0][1] and np.array_equal(w, models[0][0])


def test_slopes_are_those_of_the_risk():
    r, h = np.random.default_rng(4), 1e-6
    for shift in (0.0, -9.0, 4.0):  # with and without the second term below zero
        zp, zu = r.normal(size=6) + 3, r.normal(size=9) + shift
        first, second = risks(zp, zu, 0.3)
        assert abs(first - 0.3 * np.mean([np.log(1 + np.exp(-z)) for z in zp])) < 1e-12
        risk = (lambda a, b: sum(risks(a, b, 0.3))) if second >= 0 else (lambda a, b: -risks(a, b, 0.3)[1])
        ep, eu = slopes(zp, zu, 0.3)
        for k in range(9):
            if k < 6:
                assert abs((risk(zp + h * (np.arange(6) == k), zu) - risk(zp, zu)) / h - ep[k]) < 1e-5
            assert abs((risk(zp, zu + h * (np.arange(9) == k)) - risk(zp, zu)) / h - eu[k]) < 1e-5


def test_platt():
    r = np.random.default_rng(5)
    raw = r.normal(size=20_000)
    y = (r.random(20_000) < 1 / (1 + np.exp(-(2.5 * raw - 1)))).astype(float)
    slope, shift = platt(raw, y)
    assert abs(slope - 2.5) < 0.15 and abs(shift + 1) < 0.1
    assert platt(np.ones(3), np.ones(3)) == (1.0, 0.0)


def test_risk_stays_non_negative():
    r = np.random.default_rng(3)
    pos = Rows([(np.array([1]), np.ones(1)) for _ in range(50)])
    unl = Rows([(np.array([1 if r.random() < 0.3 else 2]), np.ones(1)) for _ in range(2000)])
    w, b = fit_nnpu(pos, unl, 0.3)
    assert b + w[1] > 0 > b + w[2]
