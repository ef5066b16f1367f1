"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Only confirmed toxic texts are used as labelled examples; the training texts at large, without their labels, are unlabelled. With a class prior p and logistic loss, the risk of a linear classifier is

    p R+(toxic examples as toxic) + max(0, R-(unlabelled as clean) - p R-(toxic examples as clean)),

(Kiryo and others, 2017), where the unlabelled texts are a sample of all training texts, toxic ones among them: the corrected second term can't be below zero in truth, so where it is on a batch, the
step goes back up on it instead of overfitting.

Features of a text: which words (lower case, without outer punctuation) and word beginnings of four and five letters
occur in it, in 2**18 hashed buckets. Only those are used that are more frequent in the toxic examples than in
clean texts (the unlabelled ones, less their toxic part by the prior) by ``min_z`` standard errors, so that the many words of a long text add no noise.

The model is fitted on at most ``max_positive`` toxic and ``max_unlabelled`` unlabelled texts (those with the smallest hash
of their doc_id), a fixed bound whatever the size of the corpus; scoring covers every row and whole text.

Defined results: null and empty texts have no features and score by the bias; without toxic examples every score is 0; a text is one example however
often its doc_id repeats among the labels; of several texts under one doc_id the one with the smallest hash is learned from; rows without doc_id are scored like any other but not learned from.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import by_slices, text_of
from quorumlens.llm.sparse import Hashed, Rows, sigmoid

BITS = 18
OUTER = string.punctuation + "«»“”„’‘¿¡…–—"


class WordFeatures(dict):
    """The buckets of each word (itself and its beginnings), as packed int32; bounded."""

    def __init__(self, used: np.ndarray | None = None):
        """used: marks the buckets to keep."""
        super().__init__()
        self.buckets, self.used = Hashed(BITS), used

    def __missing__(self, token: str) -> bytes:
        word = token.lower().strip(OUTER)
        names = [f"w:{word}", *(f"{k}:{word[:k]}" for k in (4, 5) if len(word) >= k)] if word else []
        found = [self.buckets.bucket(x) for x in names]
        packed = np.array([i for i in found if self.used is None or self.used[i]], np.int32).tobytes()
        if len(self) >= 200_000:
            self.clear()
        if len(token) <= 64:
            self[token] = packed
        return packed

    def row(self, text: str) -> np.ndarray:
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, text.split())), np.int32))


def contrast(positive: Rows, unlabelled: Rows, prior: float) -> np.ndarray:
    """How many standard errors each feature's share of the toxic examples is above that of clean texts, which is what the unlabelled texts have beyond their toxic part."""
    n, m = max(positive.n, 1), max(unlabelled.n, 1)
    toxic, mixed = (np.bincount(r.index, minlength=1 << BITS) / k for r, k in ((positive, n), (unlabelled, m)))
    clean = np.clip((mixed - prior * toxic) / (1 - prior), 0, 1)
    pooled = (n * toxic + m * clean + 1) / (n + m + 2)
    return (toxic - clean) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk for raw scores of toxic and unlabelled texts; the second is not below zero in truth."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step goes down on, by raw score: the sum of both terms, or back up the second where it is below zero."""
    up, uu = prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if risks(zp, zu, prior)[1] < 0:
        return up, -uu
    return prior * (sigmoid(zp) - 1) / len(zp) - up, uu


def fit_nnpu(positive: Rows, unlabelled: Rows, prior: float, epochs: int = 20, batch: int = 256, rate: float = 0.1, l1: float = 2e-4, min_z: float = 5.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier, by Adagrad on the non-negative risk with an L1 penalty."""
    w, b, gw, gb = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-4), 1e-4
    if not positive.n or not unlabelled.n:
        return w, -60.0
    b = float(np.log(prior / (1 - prior)))
    used_at_all = contrast(positive, unlabelled, prior) >= min_z
    positive, unlabelled = positive.only(used_at_all), unlabelled.only(used_at_all)
    rng = np.random.default_rng(seed)
    per = max(1, round(batch * positive.n / (positive.n + unlabelled.n)))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(positive.n), rng.permutation(unlabelled.n)
        for step, at in enumerate(range(0, unlabelled.n, batch)):
            some_u, some_p = u_order[at : at + batch], p_order[np.arange(step * per, step * per + per) % positive.n]
            (pi, _, pr), (ui, _, ur) = positive.take(some_p), unlabelled.take(some_u)
            zp = b + np.bincount(pr, w[pi], minlength=len(some_p))
            zu = b + np.bincount(ur, w[ui], minlength=len(some_u))
            ep, eu = slopes(zp, zu, prior)
            index = np.concatenate([pi, ui])
            used, where = np.unique(index, return_inverse=True)
            d = np.bincount(where, np.concatenate([ep[pr], eu[ur]]), minlength=len(used))
            gw[used] += d**2
            moved = w[used] - rate * d / np.sqrt(gw[used])
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * l1 / np.sqrt(gw[used]), 0)
            db = ep.sum() + eu.sum()
            gb += db**2
            b -= rate * db / np.sqrt(gb)
    return w, b


def packed_features(text: Column) -> Column:
    def make():
        features = WordFeatures()
        return lambda texts: [features.row(t).tobytes() for t in texts]

    return by_slices("binary", pa.binary(), make, text_of(text))


def _rows(packed: list[bytes]) -> Rows:
    return Rows([(x := np.frombuffer(b, np.int32), np.ones(len(x))) for b in packed])


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_positive: int = 4000, max_unlabelled: int = 8000, prior: float | None = None) -> tuple[np.ndarray, float]:
    """A model from ``docs`` and the ``labels`` (key, label) that may be learned from.

    A sample of all texts, labels aside, is the unlabelled set. The class prior, if not given, is the share of
    toxic rows among ``labels``. Examples are ordered by a hash of their key, so the model does not depend on how rows are dealt over tasks.
    """
    known = labels.filter(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("y"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = prior if prior is not None else min(max(toxic / n if n else 0.0, 0.001), 0.999)
    by_hash = lambda ids, most: ids.select(key, F.xxhash64(key).alias("h")).filter(F.col(key).isNotNull()).distinct().orderBy("h", key).limit(most)
    some = [by_hash(known.filter("y = 1"), max_positive).withColumns({"p": F.lit(1), "u": F.lit(0)}), by_hash(docs.select(key), max_unlabelled).withColumns({"p": F.lit(0), "u": F.lit(1)})]
    ids = some[0].unionByName(some[1]).groupBy(key, "h").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    found = docs.select(key, text_of(text).alias("text")).join(F.broadcast(ids), key)  # of bounded size
    one = found.groupBy("h", key, "p", "u").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # of an id's texts the one with the smallest hash
    sample = sorted(((r["h"], str(r["key"]), r["p"], r["u"], bytes(r["x"])) for r in one.select("h", F.col(key).alias("key"), "p", "u", packed_features(F.col("text")).alias("x")).collect()))
    return fit_nnpu(_rows([r[4] for r in sample if r[2]]), _rows([r[4] for r in sample if r[3]]), prior)


def toxicity_score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> Column:
    """Score of each row, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # of fixed size

    def make():
        w, b = shared.value
        features = WordFeatures(w != 0)
        return lambda texts: sigmoid(np.array([b + float(w[features.row(t)].sum()) for t in texts], dtype=float)).tolist()

    return by_slices("double", pa.float64(), make, text_of(text))
