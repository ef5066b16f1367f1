"""Failover, recorded answers and streams against plain Python."""

import json
import random
from datetime import datetime, timedelta


import pytest
from pyspark.sql import functions as F

from quorumlens.operators.failover import failover
from quorumlens.sources import recorded
from quorumlens.streaming import calls as C
from quorumlens.streaming.ingest import spending


def scheduler(samples, outcomes, cooldowns, cooldown, drains):
    """The runner's rules, one call after the other: {(model, seq): (status, pass, waited)}."""
    done, pending, waited = {}, dict(samples), 0.0
    for k in range(drains + 1):
        if k:
            if not pending:
                break
            waited += max(cooldowns.get(m, cooldown) for m in pending)
        later = {}
        for model, batch in pending.items():
            for at, seq in enumerate(batch):
                outcome = outcomes.get((model, seq, k), "none")
                if outcome in ("unavailable", "fatal"):
                    if outcome == "fatal" or k == drains:
                        done |= {(model, s): ("dropped" if outcome == "fatal" else "given_up", None, None) for s in batch[at:]}
                    else:
                        later[model] = batch[at:]
                    break
                done[model, seq] = ("success" if outcome == "ok" else "failed", k, waited)
        pending = later
    return done


def recorded_log(seed, passes=4):
    r = random.Random(seed)
    samples = {f"m{k}": sorted(r.sample(range(1000), r.choice([1, 5, 40]))) for k in range(8)}
    odds = {m: r.choice([0.0, 0.02, 0.2, 0.9]) for m in samples}
    outcomes = {(m, s, p): ("fatal" if r.random() < 0.1 else "unavailable") if r.random() < odds[m] else r.choice(["ok", "ok", "none"]) for m, batch in samples.items() for s in batch for p in range(passes)}
    return samples, outcomes


def tables(spark, samples, outcomes):
    return (
        spark.createDataFrame([(m, s) for m, batch in samples.items() for s in batch], "model string, seq long"),
        spark.createDataFrame([(m, s, p, o) for (m, s, p), o in outcomes.items()], "model string, seq long, pass int, outcome string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_failover_equals_a_scheduler(spark, seed):
    samples, outcomes = recorded_log(seed)
    for drains, cooldowns in ((3, {"m1": 180.0, "m7": 5.0}), (0, {})):
        kept = {k: o for k, o in outcomes.items() if k[1] % 11}  # some calls have no record
        got = {(x.model, x.seq): (x.status, x.at_pass, x.waited) for x in failover(*tables(spark, samples, kept), cooldowns, 30.0, drains).collect()}
        assert got == scheduler(samples, kept, cooldowns, 30.0, drains)
    none = failover(*(t.limit(0) for t in tables(spark, samples, outcomes)))
    assert none.count() == 0


def lines(folder, name, ids, **extra):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"id": i, "content": f"said {i}", "status": "success"} | extra) + "\n" for i in ids), "utf-8")


def test_recorded_answers(spark, tmp_path):
    recorded.register(spark)
    root = tmp_path / "rec"
    for p in ("a", "b c"):
        for m in ("m0", "m1"):
            lines(root / recorded.folder_name("prompt", p) / f"model={m}", "run-1.jsonl", [f"{p}{m}{k}" for k in range(5)], input_tokens=3)
    for path in (str(root), root.as_uri()):
        read = spark.read.format("recorded_answers").option("path", path).load()
        assert read.count() == 20 and read.select("input_tokens", "latency_ms").distinct().collect() == [(3, None)]
        some = read.filter((F.col("prompt") == "b c") & F.col("model").isin("m1", "m9"))
        assert sorted(x.id for x in some.collect()) == [f"b cm1{k}" for k in range(5)] and some.rdd.getNumPartitions() == 1  # the other files are never planned
    assert read.filter("prompt = 'none'").count() == 0 and read.filter("prompt is null").count() == 0
    assert spark.read.format("recorded_answers").option("path", str(tmp_path / "nothing")).load().count() == 0
    recorded.record(read, str(tmp_path / "copy"))
    again = spark.read.format("recorded_answers").option("path", str(tmp_path / "copy")).load()
    assert sorted(map(str, again.collect())) == sorted(map(str, read.collect()))


def test_recorded_stream_starts_again_where_it_ended(spark, tmp_path):
    recorded.register(spark)
    root, wrote = tmp_path / "rec", []
    for k, (name, models) in enumerate([("run-1.jsonl", ["m0"]), ("run-2.jsonl", ["m0", "m1"]), ("run-3.jsonl", ["m1"])]):
        for m in models:
            ids = [f"{name}{m}{j}" for j in range(4)]
            wrote += ids
            lines(root / "prompt=p" / f"model={m}", name, ids)
        stream = spark.readStream.format("recorded_answers").option("path", str(root)).option("files_per_batch", 1).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        assert sorted(x.id for x in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(wrote)


def test_answers_meet_their_calls_and_late_rows_count(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    asked = [(1, at(0)), (2, at(1)), (3, at(2)), (9, at(600)), (4, at(3))]  # 4 comes when the watermark is far ahead
    said = [(1, at(5), "x"), (1, at(5), "x"), (2, at(30), "too slow"), (3, at(1), "before"), (9, at(601), "y"), (8, at(700), "none asked")]
    a = spark.createDataFrame(asked, "call_id long, asked timestamp")
    b = spark.createDataFrame(said, "call_id long, answered timestamp, text string")
    a.filter("call_id <> 4").coalesce(1).write.parquet(str(tmp_path / "a"))
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    stream = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))

    def run():
        met = C.answered(C.once(stream("a", a), "call_id", time="asked", late="20 minutes"), C.once(stream("b", b), "call_id", time="answered", late="20 minutes"))
        query = C.to_files(met, str(tmp_path / "out"), str(tmp_path / "c"))
        query.awaitTermination(120)
        return C.too_late(query)

    assert run() == 0
    a.filter("call_id = 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    assert run() == 1
    got = {x.call_id: x.text for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "x", 2: None, 3: None, 9: "y"}
    batch = C.answered(a.dropDuplicates(["call_id"]), b.dropDuplicates(["call_id"]))
    assert {x.call_id: x.text for x in batch.collect()} == got | {4: None}


def test_spending_in_windows(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    calls = spark.createDataFrame([("m0", at(0), 1.0), ("m0", at(59), 2.0), ("m0", at(60), 4.0), ("m1", at(61), None)], "model string, timestamp timestamp, cost_usd double")
    got = {(x.model, x.window.start.hour): (x.calls, x.cost_usd) for x in spending(calls).collect()}
    assert got == {("m0", 0): (2, 3.0), ("m0", 1): (1, 4.0), ("m1", 1): (1, None)}
