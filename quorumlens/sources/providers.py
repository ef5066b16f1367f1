"""Labelers as pluggable functions over partitions; the replay provider answers from recorded rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quorumlens.session import written

ANSWERS = "id string, content string, latency_ms double, input_tokens long, output_tokens long, audio_input_tokens long, attempts int, status string"


class Unavailable(Exception):
    """The model can't answer now; the rest of its batch waits for a later pass."""


def ask(work: DataFrame, provider: Callable[[dict], dict], valid: Callable[[dict], bool], tries: int = 3) -> DataFrame:
    """Answers for rows of work (id, ...), up to ``tries`` times until valid; the last answer is kept. Deferred rows have status ``deferred``."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        away = False
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                answer, n, status = {}, 0, "deferred"
                while not away and n < tries:
                    n += 1
                    try:
                        answer = provider(row)
                    except Unavailable:
                        away = True
                        break
                    status = "success" if valid(answer) else "failed"
                    if status == "success":
                        break
                rows.append({"id": row["id"], "attempts": n, "status": "deferred" if away and status == "deferred" else status} | {c: answer.get(c) for c in ("content", "latency_ms", "input_tokens", "output_tokens", "audio_input_tokens")})
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])
            yield frame.astype({c: "Int64" for c in ("input_tokens", "output_tokens", "audio_input_tokens")})

    return work.mapInPandas(label, ANSWERS)


def replay(work: DataFrame, recorded: DataFrame, key: list[str]) -> DataFrame:
    """Recorded answers joined to the work table: no calls at all."""
    return work.join(recorded, key, "left")


def passes(work: DataFrame, run: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """Runs the work, then what was deferred, up to ``most`` times more; what is still deferred stays so marked."""
    done = written(run(work))
    for _ in range(most):
        waiting = done.filter("status = 'deferred'").select("id")
        if waiting.isEmpty():
            break
        again = run(work.join(waiting, "id", "left_semi"))
        done = done.filter("status <> 'deferred'").unionByName(again)
        done = written(done)
    return done
