import ast
import json
import random

from pyspark.sql import functions as F

from quorumlens.functions.payloads import modalities
from quorumlens.functions.scores import coerce_scores
from quorumlens.functions.similarity import with_chrf
from quorumlens.operators import judging
from quorumlens.operators.scoring import Scorer, chrf_scorer, scored
from quorumlens.sources.samples import collected_samples, image_files, labelled_by_name, pool_sample


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def got(result):
    found, missing = result
    return sorted((x.path, x.label, x.label_name, x.source_class, x.annotation, x.origin) for x in found.collect()), missing.first()[0]


def test_three_layouts(spark):
    there = files(spark, "images/a.jpg", "images/sad_2.PNG", "images/c.jpg", "images/notes.txt", "happy/x.jpg", "Angry/y/z.jpg", "contempt/q.jpg", "fear_9.jpg")
    told = lines(spark, "name expression", "a.jpg 1 0.5 -0.2", "sad_2.PNG,none,x", "", "gone.jpg 3", "c.jpg 9", "b.gif 1")
    assert got(collected_samples(there, told)) == ([("images/a.jpg", 1, "happy", "happy", "1 0.5 -0.2", "annotation"), ("images/sad_2.PNG", 2, "sad", "sad", "none x", "annotation")], 1)
    only_prefix = [("images/sad_2.PNG", 2, "sad", "sad", "", "prefix")]
    assert got(collected_samples(there)) == (only_prefix, 0) and got(collected_samples(there, lines(spark, "gone.jpg 3"))) == (only_prefix, 1)
    folders = files(spark, "images/a.jpg", "happy/x.jpg", "Angry/y/z.jpg", "contempt/q.jpg", "fear_9.jpg")
    assert got(collected_samples(folders)) == ([("Angry/y/z.jpg", 6, "anger", "Angry", "", "folder"), ("happy/x.jpg", 1, "happy", "happy", "", "folder")], 0)
    assert got(collected_samples(files(spark, "fear_9.jpg", "happy/x.jpg"))) == ([("fear_9.jpg", 4, "fear", "fear", "", "prefix")], 0)
    assert got(collected_samples(files(spark, "q.jpg"))) == ([], 0) and got(collected_samples(files(spark).limit(0), lines(spark, "a.jpg 1"))) == ([], 1)


def test_image_files(spark, tmp_path):
    for name in ("images/a.jpg", "images/b.txt", "sad/c.PNG"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    assert sorted(map(tuple, image_files(spark, str(tmp_path)).collect())) == [("images/a.jpg", 5), ("sad/c.PNG", 5)]


def test_names_and_modalities(spark):
    named = labelled_by_name(files(spark, "x/happy_1.jpg", "sad/q_1.jpg", "x/3_a.jpg", "x/y.jpg"))
    assert [x.label_name for x in named.collect()] == ["happy", "sad", "surprise", None]
    rows = spark.createDataFrame([("t", "", None), ("t", "a.wav", None), (None, None, "i.png"), ("", None, None)], "t string, a string, i string")
    assert [x.m for x in rows.select(modalities(F.col("t"), F.col("a"), F.col("i")).alias("m")).collect()] == [["text", "audio"], ["text", "audio"], ["text", "image"], ["text"]]


def test_pool_sample(spark):
    pool = spark.range(1, 1001).select(F.col("id").alias("clip"), (F.col("id") % 13).cast("double").alias("duration"))
    taken, report = pool_sample(pool, 5, "clip", F.col("duration").between(2, 10), multiplier=20)
    rows = taken.collect()
    assert [x.id for x in sorted(rows, key=lambda x: x.id)] == [1, 2, 3, 4, 5] and all(x.clip <= 100 and 2 <= x.duration <= 10 for x in rows)
    assert tuple(report.first()) == (5, 5, False)
    assert tuple(pool_sample(pool, 5, "clip", F.col("duration") > 99)[1].first()) == (5, 0, True)


def test_each_distinct_triple_is_scored_once(spark):
    asked, loaded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loaded.add(1)

        def score(triples):
            asked.add(len(triples))
            return [len(o) / (1 + len(r)) + len(s) for s, o, r in triples]

        return score

    r = random.Random(1)
    rows = [(k, r.choice(["s", None]), r.choice(["a", "bb", "", None, "ab"]), r.choice(["x", "yy", " "])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, source string, output string, reference string").repartition(7)
    some, memo = scored(df.filter("id < 200"), Scorer("test-1", load))
    first = {(s or "", o, ref) for _, s, o, ref in rows[:200] if o and ref.strip()}
    assert asked.value == len(first) == memo.count()
    out, memo = scored(df, Scorer("test-1", load), memo)
    every = {(s or "", o, ref) for _, s, o, ref in rows if o and ref.strip()}
    assert asked.value == len(every) == memo.count() and loaded.value <= asked.value
    want = {k: (len(o) / (1 + len(ref)) + len(s or "") if o and ref.strip() else None) for k, s, o, ref in rows}
    assert {x.id: x.score for x in out.collect()} == want
    other, _ = scored(df, Scorer("test-2", load), memo)
    assert other.count() == 500 and asked.value == 2 * len(every)  # another model's scores are its own


def test_offline_scorer_equals_the_expression(spark):
    r = random.Random(2)
    make = lambda: "".join(r.choices("abc d", k=r.randrange(1, 20))) or "a"
    df = spark.createDataFrame([(k, "s", make(), make()) for k in range(100)], "id long, source string, output string, reference string")
    out, _ = scored(df, chrf_scorer())
    both = with_chrf(out.filter("score is not null"), "reference", "output").collect()
    assert len(both) > 80 and all(abs(x.score - x.chrf) < 1e-12 for x in both)


def test_score_maps_in_literal_form(spark):
    r = random.Random(3)
    text = lambda: r.choice(["a", "it's", 'say "x"', "None", "True:", "b\\c", "é", "{x}", ", "])
    maps = [{text(): r.choice([1, 0.25, -3, None, True, False, "0.5", "no", "None"]) for _ in range(r.randrange(5))} for _ in range(200)]
    texts = [str(m) for m in maps] + [json.dumps(m) for m in maps] + ["", "bad", "[1]", "{'a': True"]

    def plain(t):
        try:
            m = json.loads(t)
        except ValueError:
            try:
                m = ast.literal_eval(t)
            except (ValueError, SyntaxError):
                return None
        if not isinstance(m, dict):
            return None
        number = lambda v: None if v is None else float(v) if not isinstance(v, str) or v.replace(".", "").isdigit() else None
        return {k: number(v) for k, v in m.items()}

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", coerce_scores(F.col("t")).alias("m")).collect()
    assert {x.id: x.m for x in rows} == {k: plain(t) for k, t in enumerate(texts)}


def test_best_service_and_typed_scores(spark):
    rows = [(1, 0, "a", 0.5), (1, 1, "b", 0.2), (1, 2, "c", 0.2), (2, 0, "a", None), (2, 1, "b", 0.9), (3, 0, "a", None)]
    df = spark.createDataFrame(rows, "id long, svc_ord int, service string, m double")
    assert sorted(map(tuple, judging.best_service(df, "m", False, "id").collect())) == [(1, "b"), (2, "b")]
    assert sorted(map(tuple, judging.best_service(df, "m", True, "id").collect())) == [(1, "a"), (2, "b")]
    said = ['{"scores": {"a": "0.5", "b": true}}', '{"scores": {"a": 0}}', '{"scores": {"a": -1, "b": 2e-1}}', "{}", "bad", None]
    answers = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "id int, t string")
    listed = F.array(F.lit("a"), F.lit("b"))
    assert [x.u for x in answers.select("id", judging.usable(F.lit("a"), judging.number_scores(F.col("t")), listed).alias("u")).orderBy("id").collect()] == [False, True, True, False, False, False]
