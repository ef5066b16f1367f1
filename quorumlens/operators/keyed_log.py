"""Keyed tables that grow by what changes: append-only deltas in key-hash buckets, merged when read, compacted bucket by bucket.

A version is a folder ``data/log_version=V`` with one subfolder for each bucket that it touches, so an upsert writes its own rows and nothing else. A commit is one small
file ``commits/V.json``, created if it does not exist and never changed: it says where the table stands, so a reader looks at the latest commit only, sees whole
versions, and a second writer of the same version fails instead of overwriting. A bucket's floor is the version
that last rewrote it whole; what is older is not read any more.

The last version of a key wins, with all rows that version has of it. Keys compare null to null, and ids in their normal form.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.functions.text import normalize_id
from quorumlens.sources.files import Store

VERSION, BUCKET = "log_version", "log_bucket"


class KeyedLog:
    """A keyed table in a folder. Buckets are fixed when the table is made: about as many as the tasks that should rewrite it."""

    def __init__(self, spark: SparkSession, path: str, key: Iterable[str], buckets: int = 16):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.store = Store(spark)
        self.state = {"version": -1, "buckets": buckets, "floors": [0] * buckets, "holds": {}, "batches": {}}

    def latest(self) -> dict:
        """Where the table stands: version, floors of the buckets, the buckets that each version holds, the last batch of each stream."""
        names = [n for n in self.store.names(f"{self.path}/commits") if n.endswith(".json")]
        for name in sorted(names, reverse=True):
            if text := self.store.read(f"{self.path}/commits/{name}"):  # an empty one was cut off before it committed anything
                return json.loads(text)
        return json.loads(json.dumps(self.state))

    def upsert(self, new: DataFrame, stream: str | None = None, batch: int | None = None) -> bool:
        """Commits the rows; False where this batch of the stream was committed before."""
        state = self.latest()
        if stream is not None and batch is not None and batch <= state["batches"].get(stream, -1):
            return False
        if taken := {VERSION, BUCKET} & set(new.columns):
            raise ValueError(f"columns that the log needs itself: {sorted(taken)}")
        version = state["version"] + 1
        held = self._write(new, version, state["buckets"])
        state["holds"][str(version)] = held
        if stream is not None and batch is not None:
            state["batches"][stream] = batch
        self._commit(state | {"version": version})
        return True

    def read(self, state: dict | None = None) -> DataFrame | None:
        """The latest rows of each key. Buckets that no delta touched are scanned and no more; deltas are reduced to the last version of a key, and the rest of the base stays by an anti-join."""
        state = state or self.latest()
        rows = self._live(state)
        if rows is None:
            return None
        floor = F.element_at(F.array(*[F.lit(f) for f in state["floors"]]), F.col(BUCKET) + 1)
        base, later = rows.filter(F.col(VERSION) == floor), rows.filter(F.col(VERSION) > floor)
        kept = [c for c in rows.columns if c not in (VERSION, BUCKET)]
        if all(min(state["floors"][b], int(v)) == int(v) for v, held in state["holds"].items() for b in held):
            return base.select(*kept)  # no deltas
        names = [f"key_{k}" for k in range(len(self.key))]
        keyed = later.withColumns(dict(zip(names, self.key_columns(), strict=True)))
        last = keyed.groupBy(*names).agg(F.max(VERSION).alias("last"))
        same = lambda left: self._all([x.eqNullSafe(F.col(f"l.{n}")) for x, n in zip(left, names, strict=True)])
        new = keyed.alias("k").join(last.alias("l"), same([F.col(f"k.{n}") for n in names]) & (F.col(VERSION) == F.col("l.last")), "left_semi")
        old = base.alias("b").join(last.alias("l"), same(self.key_columns("b.")), "left_anti")
        return old.select(*kept).unionByName(new.select(*kept))

    def compact(self, runs: int = 4) -> list[int]:
        """Rewrites the buckets that have at least so many versions to merge, and gives their numbers."""
        state = self.latest()
        count = [sum(b in held for v, held in state["holds"].items() if int(v) >= f) for b, f in enumerate(state["floors"])]
        worn = [b for b, n in enumerate(count) if n >= max(2, runs)]
        if worn:
            version = state["version"] + 1
            part = self.read(state | {"holds": {v: [b for b in held if b in worn] for v, held in state["holds"].items()}})
            held = self._write(part, version, state["buckets"])
            state["holds"][str(version)] = held
            state["floors"] = [version if b in worn else f for b, f in enumerate(state["floors"])]
            state["holds"] = {v: left for v, held in state["holds"].items() if (left := [b for b in held if int(v) >= state["floors"][b]])}
            self._commit(state | {"version": version})
        return worn

    def vacuum(self) -> list[str]:
        """Deletes the versions that the latest commit does not need, and names them; for a time without readers of older ones."""
        state = self.latest()
        old = [n for n in self.store.names(f"{self.path}/data") if n.startswith(f"{VERSION}=") and n.split("=")[1] not in state["holds"] and int(n.split("=")[1]) <= state["version"]]
        for name in old:
            self.store.delete(f"{self.path}/data/{name}")
        return old

    def key_columns(self, prefix: str = "") -> list[Column]:
        """The key as it is compared."""
        return [normalize_id(F.col(f"{prefix}{c}")) if c == "id" else F.col(f"{prefix}{c}") for c in self.key]

    @staticmethod
    def _all(terms: list[Column]) -> Column:
        first, *rest = terms
        for x in rest:
            first = first & x
        return first

    def _live(self, state: dict) -> DataFrame | None:
        parts = [f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for v, held in sorted(state["holds"].items(), key=lambda x: int(x[0])) for b in held if int(v) >= state["floors"][b]]
        if not parts:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", True).parquet(*parts)

    def _write(self, rows: DataFrame, version: int, buckets: int) -> list[int]:
        """Writes a version; which buckets it holds. Few rows become one file a bucket, many are split."""
        target = f"{self.path}/data/{VERSION}={version}"
        placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.key_columns()), F.lit(buckets)).cast("int"))
        placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)  # what a failed try left is not committed
        return sorted(int(n.split("=")[1]) for n in self.store.names(target) if n.startswith(f"{BUCKET}="))

    def _commit(self, state: dict) -> None:
        self.store.create(f"{self.path}/commits/{state['version']:012d}.json", json.dumps(state))
