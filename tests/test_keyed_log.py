import random

import pytest
from pyspark.sql import functions as F

from quorumlens.operators.keyed_log import KeyedLog
from quorumlens.operators.store import overwrite_slices
from quorumlens.sources.files import Store

SCHEMA = "prompt string, id string, v long"


def test_random_upserts_and_compactions_equal_a_dict(spark, tmp_path):
    r = random.Random(1)
    log, want = KeyedLog(spark, str(tmp_path / "log"), ["prompt", "id"], buckets=4), {}
    assert log.read() is None and log.compact() == []
    for step in range(9):
        rows = {(r.choice(["a", "b", None]), r.choice(["", "s"]) + str(r.randrange(12)).zfill(r.choice([1, 4]))): r.randrange(1000) for _ in range(r.choice([1, 3, 10]))}
        rows = {(p, i.removeprefix("s")): (p, i, v) for (p, i), v in rows.items()}
        norm = {(p, i.zfill(4)): row for (p, i), row in rows.items()}
        log.upsert(spark.createDataFrame(list(norm.values()), SCHEMA))
        want |= {k: v[2] for k, v in norm.items()}
        if step in (3, 5):
            log.compact(2)
        got = {(x.prompt, x.id.removeprefix("s").zfill(4)): x.v for x in log.read().collect()}
        assert got == want and log.read().count() == len(want)
    assert log.compact(2) and "Join" not in log.read()._jdf.queryExecution().toString()  # whole again: a plain scan
    assert {(x.prompt, x.id.removeprefix("s").zfill(4)): x.v for x in log.read().collect()} == want
    before = log.vacuum()
    assert before and log.vacuum() == [] and log.read().count() == len(want)


def test_an_upsert_writes_what_it_holds(spark, tmp_path):
    files, path = Store(spark), str(tmp_path / "log")
    log = KeyedLog(spark, path, ["id"], buckets=2)
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    log.upsert(rows)
    whole = files.size(f"{path}/data")
    log.upsert(rows.filter("id % 100 = 7").withColumn("text", F.lit("new")))
    assert files.size(f"{path}/data") - whole < 0.02 * whole
    got = log.read()
    assert got.count() == 200_000 and got.filter("text = 'new'").count() == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("FileScan") >= 2  # the large base is not shuffled


def test_replays_missing_columns_and_writers(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), ["id"], buckets=3)
    assert log.upsert(spark.createDataFrame([("1", 1), ("2", 2), (None, 3)], "id string, v long"), "s", 0)
    assert not log.upsert(spark.createDataFrame([("1", 99)], "id string, v long"), "s", 0)
    assert log.upsert(spark.createDataFrame([("0001", "x"), (None, "y")], "id string, w string"), "s", 1)
    assert not log.upsert(spark.createDataFrame([("1", 99)], "id string, v long"), "s", 1)
    assert sorted(map(str, (tuple(x) for x in log.read().select("id", "v", "w").collect()))) == ["('0001', None, 'x')", "('2', 2, None)", "(None, None, 'y')"]
    assert log.upsert(spark.createDataFrame([], "id string, v long")) and log.read().count() == 3
    with pytest.raises(ValueError):
        log.upsert(spark.createDataFrame([("1", 1)], "id string, log_bucket long"))
    state = log.latest()
    with pytest.raises(Exception, match="exist"):  # another writer was first
        log._commit(state)
    Store(spark).create(f"{log.path}/commits/{state['version'] + 1:012d}.json", "")  # a writer that died in its commit
    assert log.read().count() == 3


def test_other_slices_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.range(300).select((F.col("id") % 3).cast("string").alias("task"), "id", F.lit("old").alias("origin"))
    overwrite_slices(rows, path, "task")
    files = lambda: {t: Store(spark).names(f"{path}/task={t}") for t in "012"}
    before = files()
    overwrite_slices(rows.filter("task = '1'").limit(5).withColumn("origin", F.lit("new")), path, "task")
    after = files()
    assert after["0"] == before["0"] and after["2"] == before["2"] and after["1"] != before["1"]
    back = spark.read.parquet(path)
    assert {(r.task, r.origin): r["count"] for r in back.groupBy("task", "origin").count().collect()} == {(0, "old"): 100, (1, "new"): 5, (2, "old"): 100}
    plan = back.filter("task = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(task" in plan
