"""Operators on small literal tables, and against plain Python on random ones."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import costs, failures, judging, metrics, panel, store, votes


def panel_of(spark, groups):
    rows = [(i, k, f"s{k}", x) for i, g in enumerate(groups) for k, x in enumerate(g)]
    return spark.createDataFrame(rows, "id long, svc_ord int, service string, service_output string")


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (x != y)))
        last = new
    return last[-1]


def test_word_errors(spark):
    pairs = [("the cat sat on the mat", "the cat sit on mat now"), ("Hello, World!", "hello world"), ("", "a b"), (None, "a"), ("a b", ""), ("", ""), ("don't stop", "dont stop"), ("élan vital", "lan vital")]
    df = spark.createDataFrame([(i, "s", a, b) for i, (a, b) in enumerate(pairs)], "id long, service string, human string, service_output string")
    rows = metrics.word_error_rows(df)
    assert [(r.human_errors, r.human_ref_words) for r in rows.orderBy("id").collect()] == [(3, 6), (0, 2), (2, 0), (1, 0), (2, 2), (0, 0), (1, 2), (0, 2)]
    assert metrics.word_error_rate(rows, "service").first().wer == 9 / 14


def test_word_errors_on_random_texts(spark):
    r = random.Random(1)
    make = lambda: " ".join(r.choices("a b c dd e'e".split(), k=r.randint(0, 9)))
    pairs = [(make(), make()) for _ in range(300)]
    df = spark.createDataFrame([(i, "s", a, b) for i, (a, b) in enumerate(pairs)], "id long, service string, human string, service_output string")
    got = [r.human_errors for r in metrics.word_error_rows(df).orderBy("id").collect()]
    assert got == [distance(a.split(), b.split()) for a, b in pairs]


def test_classification(spark):
    rows = [("happy", "happy"), ("happy", "sad"), ("sad", "sad"), ("", "happy"), ("contempt", "sad"), ("anger", "")]
    df = metrics.label_rows(spark.createDataFrame(rows, "reference string, label string"))
    counts = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.confusion(df).collect()}
    assert (counts["happy"], counts["sad"], counts["anger"]) == ((1, 0, 1), (1, 2, 0), (0, 0, 1))
    s = metrics.classification_summary(df).first()
    assert (s.n, s.accuracy, round(s.macro_f1, 6), s.micro_f1, round(s.weighted_f1, 6)) == (4, 0.5, 0.388889, 0.5, 0.458333)


def test_mode_vote(spark):
    got = votes.mode_vote(panel_of(spark, [["happy", "sad", "happy", ""], ["sad", "happy", "happy", "sad"], ["", ""]])).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [("happy", 2, 3, 0.6667), ("sad", 2, 4, 0.5), ("", 2, 0, 0.0)]


def test_medoid_vote(spark):
    got = votes.medoid_vote(panel_of(spark, [["a b c", "a b c", "x"], ["x", ""], ["abcd", "abce", "zzzz"], ["", ""]])).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [("a b c", 2, 3, 0.6667), ("x", 1, 1, 1.0), ("abcd", 1, 3, 0.375), ("", 2, 0, 0.0)]


def test_disagreement(spark):
    labels = votes.label_disagreement(panel_of(spark, [["happy", "happy", "sad"], ["happy"], ["a", "b", "c"]])).orderBy("id").collect()
    assert [r.discrimination for r in labels] == [0.333333, 0.0, 0.666667]
    texts = votes.text_disagreement(panel_of(spark, [["abcd", "abce", "zzzz"], ["tide", "diet"], ["diet", "tide"], ["x"]])).orderBy("id").collect()
    assert [r.discrimination for r in texts] == [0.75, 0.75, 0.5, 0.0]


def test_votes_on_random_panels(spark):
    r = random.Random(2)
    groups = [["".join(r.choices("ab ", k=r.randint(0, 6))) for _ in range(r.randint(1, 5))] for _ in range(120)]
    got = {x.id: x for x in votes.medoid_vote(panel_of(spark, groups)).collect()}
    for i, g in enumerate(groups):
        g = [" ".join(x.split()) for x in g]
        some = [x for x in g if x]
        best = max(some, key=lambda x: (some.count(x), -some.index(x)), default="")
        agree = some.count(best) / len(some) if some else 0.0
        if len(some) > 1 and len(set(some)) == len(some):
            sums = [sum(SequenceMatcher(None, a, b).ratio() for j, b in enumerate(some) if j != k) for k, a in enumerate(some)]
            best, agree = some[sums.index(max(sums))], max(sums) / (len(some) - 1)
        assert got[i].mv_label == best and abs(got[i].agreement - agree) < 1e-4


def test_ranking_and_curve(spark):
    scores = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.3)], "id long, discrimination double")
    assert [(r.rank, r.id, round(r.coverage, 6)) for r in votes.coverage_curve(scores).orderBy("rank").collect()] == [(1, 2, 0.5), (2, 3, 0.8), (3, 1, 1.0)]
    assert [r.id for r in votes.top_ids(scores, 2).collect()] == [2, 3] and votes.top_ids(scores, 0).count() == 0
    assert [r.coverage for r in votes.coverage_curve(scores.withColumn("discrimination", F.lit(0.0))).collect()] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize(("text", "used"), [("0.9", False), ("0.85", False), ("0.8499", True), (None, True), ("high", True), ("NaN", False)])
def test_fallback(spark, text, used):
    judged = spark.createDataFrame([(1, text, "model's", "s0")], "id long, confidence string, llm_label string, winner string")
    human, best = spark.createDataFrame([(1, "human's")], "id long, human_label string"), spark.createDataFrame([(1, "s2")], "id long, best_service string")
    row = judging.with_fallback(judged, human, best).first()
    assert (row.fallback_used, row.final_label, row.final_winner) == ((True, "human's", "s2") if used else (False, "model's", "s0"))
    blank = judging.with_fallback(judged, human.withColumn("human_label", F.lit(" ")), best).first()
    assert (blank.final_label, blank.final_winner) == ("model's", None if used else "s0")


def test_best_services(spark):
    rows = spark.createDataFrame([(1, "A", 0, 0.2), (1, "B", 1, 0.1), (1, "C", 2, 0.1), (2, "A", 0, None)], "id long, service string, svc_ord int, wer double")
    assert judging.best_service(rows, "wer", False, "id").collect() == [(1, "B")]
    sets = judging.best_sets(rows, "wer", False, "id")
    assert sets.collect() == [(1, ["B", "C"])]
    samples = spark.createDataFrame([("p", "m", 1, "B"), ("p", "m", 1, "A"), ("p", "m", 1, None), ("p", "m", 1, ""), ("p", "m", 9, "B")], "prompt string, model string, id long, winner string")
    assert judging.winner_agreement(samples, sets, "model").first().agreement == 1 / 3


def test_usable(spark):
    df = spark.sql("select map('A', '0.5') m union all select map('A', '-1') union all select map('A', 'true')")
    services = F.array(F.lit("A"), F.lit("B"))
    assert [r[0] for r in df.select(judging.usable(F.lit("A"), F.col("m"), services)).collect()] == [True, False, False]
    assert df.select(judging.usable(F.lit("X"), F.col("m"), services)).first()[0] is False


def test_distribution_and_histogram(spark):
    rows = spark.createDataFrame([("p", "m", "s", x) for x in (0.1, 0.4, 0.9, 0.95, -1.0)] + [("q", "m", "t", 0.5)], "prompt string, model string, service string, score double")
    d = {(r.prompt, r.service): r for r in judging.score_distribution(rows).collect()}
    s = d["p", "s"]
    assert (s.n, round(s["mean"], 4), round(s["std"], 6), s.low, round(s.p25, 3), round(s["median"], 2), round(s.p75, 4), s.high) == (4, 0.5875, 0.409013, 0.1, 0.325, 0.65, 0.9125, 0.95)
    assert d["<all>", "s"].n == 4 and d["q", "t"]["std"] == 0.0
    values = spark.createDataFrame([(x,) for x in (0.05, 0.15, 0.30, 0.35, 0.85, 1.0)], "v double")
    assert sorted(r.bin for r in judging.histogram(values, "v").collect()) == [1, 2, 5, 6, 16, 19]


def test_upsert(spark):
    key = ["prompt", "model", "id"]
    old = spark.createDataFrame([("p", "m", "0001", "a"), ("p", "m", "0002", "b"), (None, "m", "0003", "z")], "prompt string, model string, id string, v string")
    new = spark.createDataFrame([("p", "m", "2", "c"), ("p", "m", "0003", "d"), (None, "m", "3", "y")], "prompt string, model string, id string, v string")
    once = store.upsert(old, new, key)
    assert sorted((str(r.prompt), r.id, r.v) for r in once.collect()) == [("None", "3", "y"), ("p", "0001", "a"), ("p", "0003", "d"), ("p", "2", "c")]
    assert sorted(map(str, store.upsert(once, new, key).collect())) == sorted(map(str, once.collect()))
    assert store.upsert(old, new.limit(0), key).count() == 3
    assert store.pending(old, new, key).select("id").collect() == [("0001",)]


def test_snapshots_and_stream(spark, tmp_path):
    from quorumlens.operators.keyed_log import KeyedLog
    from quorumlens.streaming.ingest import upsert_stream

    target = KeyedLog(spark, str(tmp_path / "t"), ["id"])
    assert target.read() is None
    schema = "id string, v long"
    spark.createDataFrame([("0001", 1), ("0002", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: upsert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), target, str(tmp_path / "c"), order="v").awaitTermination(60)
    run()
    spark.createDataFrame([("0002", 2), ("0002", 3), ("0003", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(target.read().collect()) == [("0001", 1), ("0002", 3), ("0003", 1)]


def test_progress(spark):
    slices = spark.createDataFrame([(5, 5), (3, 10), (0, 15)], "done long, total long")
    assert tuple(store.progress(slices).first()) == (8, 30, 2, 1, 26.7, "incomplete")


def test_failures_and_panels(spark):
    df = panel_of(spark, [["x", ""], ["y", '{"error":"x"}']])
    report = {r.service: (r.total_inputs, r.failed_inputs, r.failure_rate) for r in failures.failure_report(df, "asr", "text").collect()}
    assert report == {"s0": (2, 0, 0.0), "s1": (2, 2, 1.0)}
    assert failures.failure_report(df.drop("service_output"), "asr", "text").first().failure_rate == 1.0
    full = panel.complete_panel(spark.createDataFrame([(0,), (7,)], "id long"), ["s0", "s1"], df)
    assert full.filter("id = 7").select("service_output").collect() == [("",), ("",)] and full.count() == 4
    assert panel.service_block(df).orderBy("id").first().service_blocks == "s0: x\ns1: "


def test_attempts(spark):
    rows = [("t", "m", 1, 1, False, "a", 0.1), ("t", "m", 1, 2, True, "b", 0.2), ("t", "m", 1, 3, True, "c", 0.3), ("t", "m", 2, 1, False, "x", None), ("t", "m", 2, 2, False, "y", None)]
    got = costs.settled_attempts(spark.createDataFrame(rows, "task string, model string, id long, attempt long, ok boolean, content string, cost_usd double")).orderBy("id").collect()
    assert [(r.attempt, r.status, r.content, r.attempts, r.cost_usd) for r in got] == [(2, "success", "b", 3, 0.6), (2, "failed", "y", 2, None)]


def test_sources(spark, tmp_path):
    from quorumlens.sources import samples

    lines = spark.createDataFrame([("a.jpg,3",), ("b.png 9 2 0",), ("notes 1",), ("c.jpg",)], "value string")
    assert sorted(samples.annotations(lines).collect()) == [("a.jpg", 3, "surprise"), ("b.png", 2, "sad")]
    pool = spark.range(100).withColumn("duration", F.col("id") / 10)
    got = samples.speech_samples(pool, 20).collect()
    assert sorted(r.id for r in got) == list(range(1, 21)) and all(2 <= r.duration <= 10 for r in got)
    assert [r.source_id for r in got] == [r.source_id for r in samples.speech_samples(pool, 20).collect()]
    cat = lambda *p: spark.createDataFrame([("asr", "judge", x) for x in p], "task string, paradigm string, prompt string")
    picked, missing, skipped = samples.prompt_catalog(cat("a", "b"), cat("b", "c"))
    assert [x.select("prompt").collect() for x in (picked, missing, skipped)] == [[("b",)], [("c",)], [("a",)]]
    for name, status in (("r1", "finished"), ("r2", "incomplete")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text('{"task":"asr","date":"2026-01-01","time":"10:00","status":"%s"}' % status)
    assert samples.continuable_runs(spark, f"{tmp_path}/*/run.json", "asr").select("status").collect() == [("incomplete",)]


def test_providers(spark, tmp_path):
    from quorumlens.sources.providers import Unavailable, ask, passes

    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))

    def provider(row):
        if row["id"] == "down":
            raise Unavailable
        return {"content": row["id"], "input_tokens": 1}

    work = spark.createDataFrame([("a",), ("bad",), ("down",), ("later",)], "id string").coalesce(1)
    got = {r.id: (r.status, r.attempts) for r in passes(work, lambda w: ask(w, provider, lambda x: x["content"] != "bad"), most=2).collect()}
    assert got["a"] == ("success", 1) and got["bad"] == ("failed", 3) and got["down"][0] == "deferred"


def test_ratios_equal_the_standard_library():
    from quorumlens.functions.similarity import match_ratios

    r = random.Random(4)
    pairs = []
    for _ in range(1500):
        letters = r.choice(["ab", "abc ", "abcdefghij é😀 "])
        a = "".join(r.choices(letters, k=r.randint(0, r.choice([1, 20, 150, 260]))))
        b = "".join(c for c in a if r.random() > 0.2) if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(0, 60)))
        pairs += [(a, b), (a, a)]
    got = match_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(g - SequenceMatcher(None, a, b).ratio()) < 1e-12 for g, (a, b) in zip(got, pairs))


def test_word_errors_of_very_many_different_words(spark):
    words = [f"w{k}" for k in range(36_000)]
    df = spark.createDataFrame([(1, "s", " ".join(words), " ".join(words[:100] + ["x"] + words[101:] + ["y"]))], "id long, service string, human string, service_output string")
    short = spark.createDataFrame([(2, "s", "a b", "b a")], df.schema)
    assert sorted((x.id, x.human_errors) for x in metrics.word_error_rows(df.unionByName(short)).collect()) == [(1, 2), (2, 2)]


def test_whole_documents(spark, tmp_path):
    from quorumlens.plans.catalog import q_wer_full

    r = random.Random(7)
    docs = [(i, "en", " ".join(r.choices([f"word{k}" for k in range(400)], k=n))) for i, n in enumerate([0, 1, 30, 900, 1500])] + [(9, "de", None)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.id: (x.human_errors, x.human_ref_words) for x in q_wer_full(spark, str(tmp_path)).collect()}
    for i, _, text in docs:
        w = (text or "").split()
        said = [x for n, x in enumerate(f"x{n}" if (n + i) % 7 == 0 else x for n, x in enumerate(w)) if (n + i) % 11]
        assert got[i] == (distance(w, said), len(w))


def test_nullish_at_any_depth(spark):
    from quorumlens.functions.text import is_nullish

    cases = {'{"a":{"b":null}}': True, '{"a":{"b":[null,"n/a",{}]}}': True, '[[],[{"k":"None"}]]': True, '{"null":"x"}': False, '{"a":["null, null"]}': False, '{"a":{"b":0}}': False, '{"a":"x\\"y"}': False, "{broken": False, "NaN": True, '{"a":false}': False}
    got = dict(spark.createDataFrame([(x,) for x in cases], "x string").select("x", is_nullish(F.col("x"))).collect())
    assert got == cases


def test_reports(spark):
    from quorumlens.operators import reports

    rows = spark.createDataFrame([(1, "A", 0, 0.0), (1, "B", 1, 0.5), (2, "A", 0, 0.4), (2, "B", 1, 0.2)], "id long, service string, svc_ord int, human_wer double")
    judged = spark.createDataFrame([("p", "m", 1, "A", False), ("p", "m", 2, "A", False), ("p__no-threshold", "m", 1, "B", False), ("p", "m", 3, "A", True)], "prompt string, model string, id long, winner string, fallback_used boolean")
    voted = spark.createDataFrame([(0.5,), (1.0,)], "agreement double")
    models = spark.createDataFrame([("p", "m", 0.2), ("q", "m", 0.4)], "prompt string, model string, human_wer double")
    got = {(x.paradigm, x.model): round(x.score, 9) for x in reports.label_accuracy(rows, models, judged, judged, voted).collect()}
    assert got == {("llmaas", "m"): 0.7, ("judge", "m"): 0.25, ("human_loop", "m"): 0.5, ("majority_voting", "(no LLM)"): 0.75}
    legacy = reports.label_accuracy(rows.withColumns({"prompt": F.lit("p"), "model": F.lit("m")}), None, judged, judged, voted)
    assert round(legacy.filter("paradigm = 'oracle'").first().score, 9) == 0.725
    odd = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (0.1,)], "value double")
    assert tuple(reports.value_range(odd).first()) == (0.1, 0.5)
    assert reports.TASKS["asr"].is_correct(F.lit(0.2)) is not None


def test_config_and_runs(spark, tmp_path):
    from quorumlens.sources import config, runs

    with pytest.raises(ValueError):
        config.entries(spark, {"a": 3})
    assert config.enabled(config.entries(spark, {"a": {"enabled": True}, "b": {}, "c": None})).select("name").collect() == [("a",)]
    assert config.model_id("my-model.x", {"model_id": "z"}) == "z"
    paths = [(f"root/{p}",) for p in ("train_set/images/1.jpg", "train_set/7class_annotation.txt", "train_set/annotation.csv", "x/train/readme.md", "test/2.png", "train_zip/a/b/c.jpg")]
    df = spark.createDataFrame(paths, "path string")
    assert config.split_folder(df, "train").first().folder == "root/train_set"
    assert config.annotation_file(df).first().path == "root/train_set/7class_annotation.txt"
    joined, missing = config.with_files(spark.createDataFrame([("1.jpg", 3), ("9.jpg", 0)], "file string, label int"), df)
    assert joined.agg(missing).first()[0] == 1
    assert runs.read_or_empty(spark, str(tmp_path / "none.csv"), "id long, x string").count() == 0
    runs.save_samples(spark.range(3), str(tmp_path / "s"))
    assert runs.load_samples(spark, str(tmp_path / "s"), "id long").count() == 3
    runs.save_manifest(spark, str(tmp_path / "m"), "asr", {"n": 5})
    runs.save_manifest(spark, str(tmp_path / "m"), "asr", {"n": 5}, "finished")
    assert runs.manifest(spark, str(tmp_path / "m")).first().status == "finished"


def test_pass_is_idempotent(spark):
    from quorumlens.operators import passes

    work = spark.createDataFrame([("p", "m", i) for i in range(4)], "prompt string, model string, id long")
    done = spark.createDataFrame([("p", "m", 0, "kept", "success")], "prompt string, model string, id long, llm_oracle string, status string")
    ask = lambda w: w.withColumn("content", F.when(F.col("id") == 1, '{"transcript":"heard"}').when(F.col("id") == 2, "no json").otherwise('{"transcript":null}'))
    once = passes.oracle_pass(work, done, ask, "asr")
    rows = {x.id: (x.llm_oracle, x.status) for x in once.collect()}
    assert rows == {0: ("kept", "success"), 1: ("heard", "success"), 2: ("n/a", "failed"), 3: (None, "failed")}
    never = lambda w: w.withColumn("content", F.raise_error("asked again").cast("string"))
    assert {x.id: (x.llm_oracle, x.status) for x in passes.oracle_pass(work, once, never, "asr").collect()} == rows
    one, more = passes.own_and_model_rows(passes.as_service(once).unionByName(passes.as_service(once, "svc_0")))
    assert one.count() == more.count() == 4
