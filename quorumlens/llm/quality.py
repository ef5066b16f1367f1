"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words as they stand, in 2**15 hashed buckets, with damped counts
of unit length; twenty statistics of its structure (capitals, digits, marks, repeated words and lines,
word lengths, size), each in eight steps; and the declared length (``n_chars``) against the real one. The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2]),

so that all pairs of features interact in time linear in their number.

Raw scores become probabilities by a slope and a shift, fitted (Platt, 1999) on the fifth of the training rows that a first model does not see.

The model is fitted by numpy on at most ``max_train`` labelled rows (those with the smallest hash of their doc_id),
a fixed bound whatever the size of the corpus; scoring covers every row and whole text.

Defined results: null and empty texts have the features of no words and are scored; a null ``n_chars`` counts as the
real length; with labels of one kind only, every score is that kind's share.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import by_slices, text_of
from quorumlens.llm.sparse import Hashed, Rows, pack, sigmoid, unpack

WORD_BITS, STEPS = 15, 8
N_WORDS = 1 << WORD_BITS
MARKS = b"!#$%&*|?.,;:"
N_FEATURES = N_WORDS + STEPS * (len(MARKS) + 13)


class Features:
    """Makes the features of texts; one for each Python worker."""

    def __init__(self):
        self.buckets = Hashed(WORD_BITS)

    def row(self, text: str, n_chars: float) -> tuple[np.ndarray, np.ndarray]:
        tokens = text.split()
        ids = np.fromiter(map(self.buckets.__getitem__, tokens), np.int64, len(tokens))
        kinds, counts = np.unique(ids, return_counts=True)
        weight = np.log1p(counts)
        weight /= max(np.sqrt((weight**2).sum()), 1e-9)
        stats = np.clip(self.statistics(text, tokens, ids, counts, n_chars), 0, 1)
        step = np.minimum((stats * STEPS).astype(np.int64), STEPS - 1)
        return np.concatenate([kinds, N_WORDS + STEPS * np.arange(len(stats)) + step]), np.concatenate([weight, np.full(len(stats), len(stats) ** -0.5)])

    @staticmethod
    def statistics(text: str, tokens: list[str], ids: np.ndarray, counts: np.ndarray, n_chars: float) -> list[float]:
        chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        n, words, lines = max(len(text), 1), max(len(tokens), 1), text.split("\n")
        letters = max(chars[65:91].sum() + chars[97:123].sum(), 1)
        return [
            *(chars[m] / words for m in MARKS), chars[65:91].sum() / letters, 8 * chars[48:58].sum() / n, chars[128:].sum() / n / 2,
            len(counts) / words, counts.max(initial=0) / words * 2, float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0,
            len(set(lines)) / len(lines), n / words / 20, np.log1p(len(text)) / 12, np.log1p(len(lines)) / 8, np.log1p(words / len(lines)) / 8,
            max(map(len, tokens), default=0) / 40, abs(np.log1p(n_chars) - np.log1p(len(text))),
        ]


class FactorisationMachine:
    """w0, w and the factors v; fitted by Adagrad on logistic loss."""

    def __init__(self, n: int, factors: int = 8, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(n)
        self.slope, self.shift = 1.0, 0.0
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, factors))

    def parts(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores, and the factor sums of each row."""
        vx = self.v[index] * value[:, None]
        sums, squares = np.zeros((n, self.v.shape[1])), np.zeros(n)
        np.add.at(sums, row, vx)
        np.add.at(squares, row, (vx**2).sum(1))
        linear = np.bincount(row, self.w[index] * value, minlength=n)
        return self.w0 + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, rows: Rows, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> None:
        if len(set(y.tolist())) < 2:
            share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
            self.w0 = float(np.log(share / (1 - share)))
            self.v[:] = 0
            return
        gw, gv, g0, rng = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6, np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(rows.n)
            for at in range(0, rows.n, batch):
                some = order[at : at + batch]
                index, value, row = rows.take(some)
                raw, sums = self.parts(index, value, row, len(some))
                error = sigmoid(raw) - y[some]
                used, where = np.unique(index, return_inverse=True)
                dw = np.bincount(where, error[row] * value, minlength=len(used)) + decay * self.w[used]
                dv = np.zeros((len(used), self.v.shape[1]))
                np.add.at(dv, where, (error[row] * value)[:, None] * (sums[row] - self.v[index] * value[:, None]))
                dv += decay * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
                g0 += error.sum() ** 2
                self.w0 -= rate * error.sum() / np.sqrt(g0)

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """The score of one row, in time linear in its features."""
        vx = self.v[index] * value[:, None]
        s = vx.sum(0)
        raw = self.w0 + self.w[index] @ value + 0.5 * (s @ s - (vx * vx).sum())
        return float(sigmoid(self.slope * raw + self.shift))


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope (above 0) and shift of a logistic curve from raw scores to labels, by Newton steps on smoothed targets; 1 and 0 where a kind is missing."""
    n, good = len(y), int(y.sum())
    if good in (0, n):
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (n - good + 2))
    x, at = np.stack([raw, np.ones(n)], 1), np.array([0.0, np.log((good + 1) / (n - good + 1))])
    for _ in range(steps):
        p = sigmoid(x @ at)
        slope = x.T @ (target - p) - 1e-3 * at
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at = at + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def _length(text: Column, n_chars: Column | None) -> Column:
    real = F.char_length(text)
    return F.coalesce(n_chars, real).cast("double") if n_chars is not None else real.cast("double")


def packed_features(text: Column, n_chars: Column | None = None) -> Column:
    def make():
        features = Features()
        return lambda texts, lengths: [pack(*features.row(t, n)) for t, n in zip(texts, lengths, strict=True)]

    return by_slices("binary", pa.binary(), make, text_of(text), _length(text_of(text), n_chars))


def fit_quality(labelled: DataFrame, text: str = "text", label: str = "quality", n_chars: str | None = "n_chars", key: str = "doc_id", max_train: int = 6000) -> FactorisationMachine:
    """A model from at most ``max_train`` rows of ``labelled``; rows without a label are left out."""
    rows = labelled.filter(F.col(label).isNotNull())
    some = rows.select(F.xxhash64(key).alias("h"), key, label, text, *([n_chars] if n_chars else [])).orderBy("h", key).limit(max_train)
    found = some.select(F.col(label).cast("double").alias("y"), packed_features(F.col(text), F.col(n_chars) if n_chars else None).alias("x")).toPandas()
    return fit_calibrated([unpack(bytes(x)) for x in found["x"]], found["y"].to_numpy(float))


def fit_calibrated(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> FactorisationMachine:
    """A machine fitted on all rows, whose probabilities are calibrated on every fifth by a machine fitted on the others."""
    machine, first = FactorisationMachine(N_FEATURES), FactorisationMachine(N_FEATURES)
    machine.fit(Rows(rows), y)
    out = np.arange(len(rows)) % 5 == 0
    if 0 < y[out].sum() < out.sum() and 0 < y[~out].sum() < (~out).sum():
        first.fit(Rows([x for x, o in zip(rows, out, strict=True) if not o]), y[~out])
        held = Rows([x for x, o in zip(rows, out, strict=True) if o])
        raw, _ = first.parts(*held.take(np.arange(held.n)), held.n)
        machine.slope, machine.shift = platt(raw, y[out])
    return machine


def quality_score(docs: DataFrame, machine: FactorisationMachine, text: str = "text", n_chars: str | None = "n_chars") -> Column:
    """Score of each row, 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32), machine.slope, machine.shift))  # of fixed size

    def make():
        features, m = Features(), FactorisationMachine(0)
        m.w0, m.w, m.v, m.slope, m.shift = model.value
        return lambda texts, lengths: [m.score(*features.row(t, n)) for t, n in zip(texts, lengths, strict=True)]

    return by_slices("double", pa.float64(), make, text_of(text), _length(text_of(text), F.col(n_chars) if n_chars else None))
