"""Failover of models that go away: what happened to each sample, from the recorded outcomes of calls.

A model takes its samples in order. A call that finds it unavailable ends the pass: this sample and all after it are deferred to the next pass, after a cooldown. A fatal answer (credentials,
permissions) drops them for good. After the first pass come at most ``drains`` more; what is still deferred then is given up. A pass
waits for the longest cooldown among the models that are still pending, because the wait is shared.

`failover` finds this for all models at once: where a pass stops is a minimum over its rows, so a model's batch is aggregated in parts and never held as a queue, and there are as many aggregations
as passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.session import written

OK, NOTHING, UNAVAILABLE, FATAL = "ok", "none", "unavailable", "fatal"
#: What becomes of a sample.
SUCCESS, FAILED, DROPPED, GIVEN_UP = "success", "failed", "dropped", "given_up"


def settled(outcome: Column) -> Column:
    return F.when(outcome == OK, SUCCESS).otherwise(FAILED)


def failover(samples: DataFrame, calls: DataFrame, cooldowns: dict[str, float] | None = None, cooldown: float = 30.0, drains: int = 3) -> DataFrame:
    """model, seq, status, at_pass (null where no pass settled it) and waited (seconds of cooldown before that pass).

    samples: model, seq (the order of its batch). calls: model, seq, pass, outcome: the answer that a call gets if that pass makes it; without any it fails ("none").
    cooldowns: seconds of single models.
    """
    waits = {m: float(s) for m, s in (cooldowns or {}).items()}
    pause = F.coalesce(*[F.when(F.col("model") == m, F.lit(s)) for m, s in waits.items()], F.lit(float(cooldown)))
    starts = samples.groupBy("model").agg(F.min("seq").alias("start"))
    done, waited = [], 0.0
    for k in range(drains + 1):
        starts = written(starts)  # one row a model that is still pending
        if k:
            longest = starts.agg(F.max(pause)).first()[0]
            if longest is None:
                break
            waited += longest
        open_ = samples.join(starts, "model").filter("seq >= start")
        asked = open_.join(calls.filter(F.col("pass") == k).select("model", "seq", "outcome"), ["model", "seq"], "left").withColumn("outcome", F.coalesce("outcome", F.lit(NOTHING)))
        halt = F.col("outcome").isin(UNAVAILABLE, FATAL)
        asked = written(asked)
        stops = written(asked.filter(halt).groupBy("model").agg(F.min(F.struct("seq", "outcome")).alias("stop")).select("model", F.col("stop.seq").alias("stop"), (F.col("stop.outcome") == FATAL).alias("fatal")))
        placed = asked.join(stops, "model", "left")
        last = F.lit(k == drains)
        status = F.when(F.col("stop").isNull() | (F.col("seq") < F.col("stop")), settled(F.col("outcome"))).when(F.col("fatal"), DROPPED).when(last, GIVEN_UP)
        ended = placed.select("model", "seq", status.alias("status")).filter("status is not null")
        made = F.col("status").isin(SUCCESS, FAILED)
        done.append(ended.select("model", "seq", "status", F.when(made, k).alias("at_pass"), F.when(made, waited).alias("waited")))
        starts = stops.filter("not fatal").select("model", F.col("stop").alias("start"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole
