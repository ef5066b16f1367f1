"""Learned scores of outputs against references, each distinct pair scored once and remembered."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.session import spread, written

#: What a score depends on.
TEXTS = ("source", "output", "reference")


@dataclass(frozen=True)
class Scorer:
    """A model that scores (source, output, reference) triples.

    name: of the model and its version, so that scores of different ones are never mixed. load: makes the model; called once in each worker process, when it is first needed.
    """

    name: str
    load: Callable[[], Callable[[Sequence[tuple[str, str, str]]], Sequence[float]]]
    batch: int = 64


_LOADED: dict[str, Callable] = {}


def _model(scorer: Scorer) -> Callable:
    """The worker's one instance of a model."""
    if scorer.name not in _LOADED:
        _LOADED[scorer.name] = scorer.load()
    return _LOADED[scorer.name]


def key_of(scorer: Scorer) -> Column:
    """A digest of the scorer's name and the texts, null as empty; lengths keep texts apart."""
    texts = [F.coalesce(c, F.lit("")) for c in TEXTS]
    sizes = F.concat_ws(",", *[F.length(t).cast("string") for t in texts])
    return F.sha2(F.concat(F.lit(f"{scorer.name}\n"), sizes, F.lit("\n"), *texts), 256)


def scored(rows: DataFrame, scorer: Scorer, memo: DataFrame | None = None, name: str = "score") -> tuple[DataFrame, DataFrame]:
    """``rows`` (source, output, reference, ...) with their scores, and the memo (key, score) with what was new. A blank output or reference has no score and asks no model.

    Only distinct triples that the memo does not hold go to the model; they are spread over tasks, since few rows can be much work.
    """
    blank = (F.trim(F.coalesce("output", F.lit(""))) == "") | (F.trim(F.coalesce("reference", F.lit(""))) == "")
    keyed = rows.withColumn("_key", F.when(~blank, key_of(scorer)))
    asked = keyed.filter("_key is not null").select("_key", *[F.coalesce(c, F.lit("")).alias(c) for c in TEXTS]).dropDuplicates(["_key"])
    if memo is not None:
        asked = asked.join(memo.select(F.col("key").alias("_key")), "_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), scorer.batch):
                part = b.slice(at, scorer.batch)
                triples = list(zip(*[part.column(c).to_pylist() for c in (1, 2, 3)], strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(float, _model(scorer)(triples)), pa.float64())], ["key", "score"])

    fresh = written(spread(asked, "_key").mapInArrow(run, "key string, score double"))
    known = fresh if memo is None else memo.select("key", "score").unionByName(fresh)
    out = keyed.join(known.select(F.col("key").alias("_key"), F.col("score").alias(name)), "_key", "left")
    return out.drop("_key"), known


def chrf_scorer(order: int = 3, beta: float = 2.0) -> Scorer:
    """The offline scorer: F-score over distinct character n-grams, as `with_chrf` has it."""

    def grams(text: str, n: int) -> set[str]:
        return {text[k : k + n] for k in range(len(text) - n + 1)}

    def one(output: str, reference: str) -> float:
        x, y = ("".join(t.split()) for t in (reference, output))
        total = 0.0
        for n in range(1, order + 1):
            a, b = grams(x, n), grams(y, n)
            if same := len(a & b):
                p, r = same / len(b), same / len(a)
                total += (1 + beta**2) * p * r / (beta**2 * p + r)
        return total / order

    return Scorer(f"chrf-{order}-{beta}", lambda: lambda triples: [one(output, reference) for _, output, reference in triples])
