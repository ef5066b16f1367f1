import os
import random
import tracemalloc
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorumlens.functions.similarity import match_ratios, word_distance, word_distances
from quorumlens.functions.text import tokens
from quorumlens.operators import metrics, passes, reports
from quorumlens.plans import catalog
from tests.test_operators import distance

SF = "/root/testdata/sf0.001"
WORDS = pa.list_(pa.string())


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lanes_equal_the_table():
    r = random.Random(1)
    pairs = [([], []), ([], ["a"]), (["a", "b"], [])]
    for _ in range(600):
        vocabulary = [f"w{k}" for k in range(r.choice([2, 9, 400]))]
        a = r.choices(vocabulary, k=r.choice([1, 8, 9, 40, 63, 64, 65, 90]))
        pairs.append((a, [w for w in a if r.random() < 0.8] if r.random() < 0.5 else r.choices(vocabulary, k=r.randrange(90))))
    got = word_distances(*(pa.array([p[k] for p in pairs], WORDS) for k in (0, 1)))
    assert got.tolist() == [distance(a, b) for a, b in pairs]
    assert got.tolist() == [word_distance(a, b) for a, b in pairs]


def test_words_are_found_in_one_pass(spark):
    texts = ["It's  A–b, c1!", None, "", "  ", "ÉTÉ's 'x' \n\t y-z", "ß''9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [x.w for x in df.select(tokens(F.col("t")).alias("w")).collect()] == [["it's", "a", "b", "c1"], [], [], [], ["t", "'s", "'x'", "y", "z"], ["''9"]]
    assert "split" not in plan(df.select(tokens(F.col("t"))))


def test_sentences_of_more_words_than_letters(spark):
    """F2 to F8: 200 and more different words in a pair are one edit each, which one-byte letters in SQL can't count."""
    words = [f"w{k}" for k in range(200)]
    said = [f"x{k}" if k % 7 == 0 else w for k, w in enumerate(words) if k % 11]
    df = spark.createDataFrame([(1, "s", " ".join(words), " ".join(said))], "id long, service string, human string, service_output string")
    assert [x.human_errors for x in metrics.word_error_rows(df).collect()] == [distance(words, said)]


def test_errors_against_answers_are_those_of_both_texts(spark):
    """errors against the human are counted below the join with the answers, once an output."""
    r = random.Random(2)
    make = lambda: " ".join(r.choices("a b c d e".split(), k=r.randrange(8)))
    panel = spark.createDataFrame([(k, f"s{s}", make(), make()) for k in range(30) for s in range(2)], "id long, service string, human string, service_output string")
    own = spark.createDataFrame([(k, f"m{m}", make()) for k in range(29) for m in range(3)], "id long, model string, oracle string")
    columns = ["id", "service", "model", "human_errors", "human_ref_words", "human_wer", "oracle_errors", "oracle_ref_words", "oracle_wer"]
    got = metrics.error_rows_by_answer(panel, own).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, metrics.word_error_rows(panel.join(own, "id")).select(columns).collect()))
    steps = plan(got)
    join = steps.index("Join Inner")
    assert steps[:join].count("ArrowEvalPython") == 1 and steps[join:].count("ArrowEvalPython") == 1


def test_words_of_the_human_are_found_once_a_sample(spark):
    """below the services' and models' rows, not once for each of them; and no outputs are broadcast, whatever the size of the table they are exploded from."""
    for name in ("q_wer_rows", "q_llmaas_backfill"):
        steps = plan(catalog.QUERIES[name](spark, SF))
        explode = steps.index("Generate explode([")
        assert steps[:explode].count("regexp_extract_all") == 1 and steps[explode:].count("regexp_extract_all") == 1
    assert "BroadcastHashJoin" not in catalog.QUERIES["q_accuracy_by_prompt"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_words_that_a_panel_brings_are_kept(spark):
    df = spark.createDataFrame([(1, "s", "a b c", "a c"), (2, "s", None, "x")], "id long, service string, human string, service_output string")
    brought = df.withColumn("_human", tokens(F.col("human")))
    assert sorted(metrics.word_error_rows(brought).collect()) == sorted(metrics.word_error_rows(df).collect())


@pytest.mark.parametrize("name", ["q_consistency_oracle_human", "q_report_range"])
def test_a_summary_is_made_once(spark, monkeypatch, name):
    """what is read several times is the written summary, not the texts."""
    monkeypatch.setitem(os.environ, "PYTHONPATH", os.getcwd())
    assert "ArrowEvalPython" not in plan(catalog.QUERIES[name](spark, SF))


def test_a_pass_asks_and_parses_once(spark):
    """what was pending is not in the table, so the pass adds its rows without looking for their keys a second time."""
    work = spark.createDataFrame([("p", "m", str(k)) for k in range(6)], "prompt string, model string, id string")
    done = work.filter("id < 2").withColumns({"llm_oracle": F.lit("old"), "status": F.lit("success")})
    ask = lambda w: w.withColumn("content", F.concat(F.lit('{"transcript":"t'), "id", F.lit('"}')))
    got = passes.oracle_pass(work, done, ask, "asr")
    assert sorted((x.id, x.llm_oracle) for x in got.collect()) == [("0", "old"), ("1", "old"), ("2", "t2"), ("3", "t3"), ("4", "t4"), ("5", "t5")]
    assert plan(got).count("Join") == 1


def test_best_sets_are_made_once(spark):
    """F16, F11, F20: winners of judges and of the human loop meet the best sets in one join."""
    rows = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3), (2, "b", 0.3)], "id long, service string, human_wer double")
    judged = spark.createDataFrame([("p", "m", 1, "a", False), ("p", "m", 2, "b", True), ("p", "m", 3, "a", False), ("p__no-threshold", "m", 1, "b", False)], "prompt string, model string, id long, winner string, fallback_used boolean")
    voted = spark.createDataFrame([(0.5,), (1.0,)], "agreement double")
    got = reports.paradigm_consistency(rows, judged.drop("fallback_used"), judged, voted)
    assert sorted(map(tuple, got.collect())) == [("human_loop", "m", 0.5), ("judge", "m", 0.5), ("majority_voting", "(no LLM)", 0.75)]
    assert plan(got).count("Window") <= 2 and plan(got).count("Join") == 1


def test_blocks_of_bytes_equal_the_standard_library():
    """pairs a column of bytes, of one-byte, two-byte and wider letters and of all lengths below `LONG`."""
    r = random.Random(5)
    for letters in ("ab ", "aé ü\x00ÿ", "aλб中", "a\U0001F600b"):
        pairs = [("".join(r.choices(letters, k=r.randrange(260))), "".join(r.choices(letters, k=r.randrange(200)))) for _ in range(60)]
        assert match_ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_blocks_are_looked_for_in_little_memory():
    """pairs that are looked at together fit a processor's cache; before, 4,096 of 16 bits a cell did not."""
    pairs = [("ab cde" * 31 + str(k), "abc de" * 31 + str(k)) for k in range(4096)]
    tracemalloc.start()
    match_ratios([a for a, _ in pairs], [b for _, b in pairs])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 17e6, peak
