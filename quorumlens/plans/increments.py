"""Registered queries of what works in increments: the keyed log, partitioned ledgers, failover, recorded answers, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.operators import store
from quorumlens.operators.failover import failover
from quorumlens.operators.keyed_log import KeyedLog
from quorumlens.plans.catalog import ORACLE_SQL, QUERIES, UPSERT, _old_new, query
from quorumlens.session import scratch, table
from quorumlens.sources import recorded
from quorumlens.streaming import calls


@query(f"""WITH {UPSERT}, first AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.id = old.id AND new.prompt = old.prompt)),
           late AS (SELECT id, prompt, value * 2 AS value, 'late' AS origin FROM old WHERE id % 49 = 0)
           SELECT id, prompt, value, origin FROM late UNION ALL SELECT id, prompt, value, origin FROM first WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.id = first.id AND late.prompt = first.prompt)""")
def q_keyed_log(spark: SparkSession, sf: str) -> DataFrame:
    """Upserts into a keyed log: two batches of a stream, one of them replayed, a compaction between them, and a late delta."""
    old, new = _old_new(spark, sf)
    log = KeyedLog(spark, scratch(spark, "keyed-log"), ["prompt", "id"], buckets=8)
    log.upsert(old)
    log.upsert(new, "calls", 0)
    log.compact(2)
    log.upsert(new.withColumn("origin", F.lit("replayed")), "calls", 0)
    log.upsert(old.filter(F.col("id").cast("long") % 49 == 0).withColumns({"value": F.col("value") * 2, "origin": F.lit("late")}), "calls", 1)
    return log.read().select(F.col("id").cast("long").alias("id"), "prompt", "value", "origin")


@query(f"WITH {UPSERT} SELECT prompt, origin, count(*) AS n, round(sum(value::DECIMAL(28,6)), 6)::DOUBLE AS total FROM (SELECT * FROM old WHERE prompt <> 'click' UNION ALL SELECT * FROM new WHERE prompt = 'click') GROUP BY ALL")
def q_slice_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger partitioned by slice, one slice of it written anew."""
    old, new = _old_new(spark, sf)
    path = scratch(spark, "ledger")
    store.overwrite_slices(old, path, "prompt")
    store.overwrite_slices(new.filter("prompt = 'click'"), path, "prompt")
    return spark.read.parquet(path).groupBy("prompt", "origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(28,6)")), 6).cast("double").alias("total"))


PASSES = 4
SAMPLES = "samples AS (SELECT 'm' || (user_id % 5) AS model, event_id AS seq FROM events)"
CALLS = f"""calls AS (SELECT model, seq, p::INT AS pass, CASE WHEN model = 'm4' AND (seq * 31 + p * 17) % 1009 = 5 THEN 'fatal' WHEN model <> 'm0' AND (seq * 7 + p * 13) % 797 = 3 THEN 'unavailable'
                                  WHEN seq % 19 = 0 THEN 'none' ELSE 'ok' END AS outcome FROM samples, range({PASSES}) t(p))"""


def _recorded_calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    samples = table(spark, sf, "events").select(F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), F.col("event_id").alias("seq"))
    seq, p, model = F.col("seq"), F.col("pass"), F.col("model")
    outcome = F.when((model == "m4") & ((seq * 31 + p * 17) % 1009 == 5), "fatal").when((model != "m0") & ((seq * 7 + p * 13) % 797 == 3), "unavailable").when(seq % 19 == 0, "none").otherwise("ok")
    return samples, samples.withColumn("pass", F.explode(F.array(*map(F.lit, range(PASSES))))).withColumn("outcome", outcome)


def _pass_sql(k: int) -> str:
    """What pass k settles, and where the next one starts."""
    ended = "'given_up'" if k == PASSES - 1 else "NULL"
    return f"""p{k} AS (SELECT c.* FROM calls c JOIN start{k} USING (model) WHERE pass = {k} AND seq >= start),
           stop{k} AS (SELECT model, min(seq) AS stop, arg_min(outcome, seq) AS why FROM p{k} WHERE outcome IN ('fatal', 'unavailable') GROUP BY model),
           done{k} AS (SELECT model, seq, CASE WHEN stop IS NULL OR seq < stop THEN CASE outcome WHEN 'ok' THEN 'success' ELSE 'failed' END WHEN why = 'fatal' THEN 'dropped' ELSE {ended} END AS status, {k} AS pass
                       FROM p{k} LEFT JOIN stop{k} USING (model)),
           start{k + 1} AS (SELECT model, stop AS start FROM stop{k} WHERE why = 'unavailable'),
           wait{k + 1} AS (SELECT coalesce(max(CASE model WHEN 'm3' THEN 180 ELSE 30 END), 0)::DOUBLE AS seconds FROM start{k + 1})"""


@query(f"""WITH {SAMPLES}, {CALLS}, start0 AS (SELECT model, min(seq) AS start FROM samples GROUP BY model), {", ".join(map(_pass_sql, range(PASSES)))},
           waits AS (SELECT 0 AS pass, 0.0::DOUBLE AS waited UNION ALL SELECT 1, seconds FROM wait1 UNION ALL SELECT 2, wait1.seconds + wait2.seconds FROM wait1, wait2
                     UNION ALL SELECT 3, wait1.seconds + wait2.seconds + wait3.seconds FROM wait1, wait2, wait3)
           SELECT model, seq, status, CASE WHEN status IN ('success', 'failed') THEN pass END AS at_pass, CASE WHEN status IN ('success', 'failed') THEN waited END AS waited
           FROM ({" UNION ALL ".join(f"SELECT * FROM done{k} WHERE status IS NOT NULL" for k in range(PASSES))}) JOIN waits USING (pass)""")
def q_failover(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each sample when models go away: three drains, a longer cooldown of one model, a model whose credentials fail."""
    samples, calls = _recorded_calls(spark, sf)
    return failover(samples, calls, cooldowns={"m3": 180.0}, drains=PASSES - 1)


@query("""SELECT model, count(*) AS answers, sum(length(text))::BIGINT AS characters, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty
          FROM (SELECT *, 'm' || (conv_id % 3) AS model, coalesce(role, 'none') AS prompt FROM conversations) WHERE prompt = 'assistant' GROUP BY model""")
def q_recorded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns recorded as answers and read back through the data source, one prompt of them."""
    path = scratch(spark, "recording")
    turns = table(spark, sf, "conversations").select(
        F.coalesce("role", F.lit("none")).alias("prompt"), F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("content"),
        F.lit(0.0).alias("latency_ms"), F.char_length("text").cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit("success").alias("status"),
    )
    recorded.record(turns, path)
    recorded.register(spark)
    read = spark.read.format("recorded_answers").option("path", path).load().filter("prompt = 'assistant'")
    empty = F.col("content").isNull() | (F.col("content") == "")
    return read.groupBy("model").agg(F.count(F.lit(1)).alias("answers"), F.sum(F.char_length("content")).alias("characters"), F.count_if(empty).alias("empty"))


@query("""WITH asked AS (SELECT event_id AS call_id, ts AS asked, event_type FROM events WHERE event_id % 3 <> 1),
               said AS (SELECT event_id AS call_id, ts + to_minutes((event_id * 7 % 23)::INT) AS answered, value FROM events WHERE event_id % 4 <> 3)
          SELECT a.call_id, event_type, value FROM asked a LEFT JOIN said s ON s.call_id = a.call_id AND answered BETWEEN asked AND asked + INTERVAL 10 MINUTE""")
def q_stream_answered(spark: SparkSession, sf: str) -> DataFrame:
    """Calls met with their answers by two streams over `events`; answers come twice, and those of over ten minutes are none."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = events.filter("event_id % 3 <> 1").select(F.col("event_id").alias("call_id"), F.col("ts").alias("asked"), "event_type")
    delay = F.make_dt_interval(mins=(F.col("event_id") * 7 % 23).cast("int"))
    said = events.filter("event_id % 4 <> 3").select(F.col("event_id").alias("call_id"), (F.col("ts") + delay).alias("answered"), "value")
    root = scratch(spark, "stream")
    asked.write.parquet(f"{root}/asked")
    said.unionAll(said).write.parquet(f"{root}/said")
    # one row far ahead on each side, which passes the watermark so that all calls come out
    end = F.lit("2100-01-01").cast("timestamp")
    spark.range(1).select(F.lit(-1).cast("long").alias("call_id"), end.alias("asked"), F.lit("end").alias("event_type")).write.mode("append").parquet(f"{root}/asked")
    spark.range(1).select(F.lit(-1).cast("long").alias("call_id"), end.alias("answered"), F.lit(0.0).alias("value")).write.mode("append").parquet(f"{root}/said")
    stream = lambda part, frame: spark.readStream.schema(frame.schema).parquet(f"{root}/{part}")
    wide = "40 days"  # files of a table come in any order
    met = calls.answered(calls.once(stream("asked", asked), "call_id", time="asked", late=wide), calls.once(stream("said", said), "call_id", time="answered", late=wide))
    calls.to_files(met, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("call_id long, event_type string, value double").parquet(f"{root}/out").filter("call_id >= 0")
