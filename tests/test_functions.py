"""Scalar rules on small literal tables; expected values are derived by hand."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quorumlens.functions import scores as S
from quorumlens.functions import text as T


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_ids(spark):
    assert apply(spark, T.normalize_id, [None, "7", "7.0", "12345", "aa_stt_0003", "x12345", "abc", "1.5", ""]) == ["", "0007", "0007", "12345", "0003", "12345", "abc", "0005", ""]


def test_answers(spark):
    values = ['```json\n{"transcript":"hi"}\n```', '{"transcript":null}', '{"x":1}', "[1]", "oops", None]
    assert apply(spark, lambda c: T.answer(c, "transcript"), values) == ["hi", None, "n/a", "n/a", "n/a", "n/a"]


def test_nullish(spark):
    yes = [None, "", " N/A ", "None", "nan", "{}", "[]", '{"a":null,"b":"na"}']
    no = ["0", "false", "no", '{"a":0}']
    assert apply(spark, T.is_nullish, yes + no) == [True] * len(yes) + [False] * len(no)


def test_failures(spark):
    yes = [None, "", "  ", '{"error":"x"}', '{"success":false}', '{"request_id":1}']
    no = ["hello", "123", "[1]", '{"error":""}', '{"error":null}', '{"success":0}', '{"text":"ok"}', "{broken"]
    assert apply(spark, T.is_failed_text, yes + no) == [True] * len(yes) + [False] * len(no)
    yes = [None, "happy", '{"top_emotion":{"name":null}}', '{"top_emotion":{"name":" "}}', '{"error":"x","top_emotion":{"name":"sad"}}', "[1]"]
    assert apply(spark, T.is_failed_label, yes + ['{"top_emotion":{"name":"happy","score":0.9}}']) == [True] * len(yes) + [False]


def test_labels(spark):
    values = ['{"top_emotion":{"name":"Sad"}}', "Happy ", None, '{"label_name":"fear"}']
    assert apply(spark, T.top_label, values) == ["sad", "happy", "", "fear"]
    assert apply(spark, lambda c: T.top_label(c, "empty"), values) == ["sad", "", "", "fear"]
    assert apply(spark, S.class_name, ["Angry", "0", "contempt", "7", "x", None]) == ["anger", "neutral", None, None, None, None]
    best = lambda c: S.best_label(S.coerce_scores(c), S.LABEL_ALIASES)
    assert apply(spark, best, ["{'happiness': 0.6, 'sadness': 0.6}", '{"a": null}', '{"Sad": "1"}', None]) == ["happy", "", "sad", ""]


def test_projection(spark):
    df = spark.sql("select map('calm', 0.2D, 'confused', 0.1D, 'happy', 0.7D) m, map('anger', 0.3D, 'happy', 0.3D, 'contempt', cast(null as double)) n")
    out = df.select(S.project_scores(F.col("m"), {"calm": "neutral", "confused": "neutral", "happy": "happy"}), S.renormalize(F.col("n"))).first()
    assert out[0] == {"neutral": 0.1, "happy": 0.7} and out[1] == {"anger": 0.5, "happy": 0.5, "contempt": None}


@pytest.mark.parametrize(("row", "cost"), [((1000, 200, 400), 0.00108), ((100, 0, 150), 0.00015), ((0, 0, 0), 0.0), ((None, None, None), None)])
def test_model_price(spark, row, cost):
    df = spark.createDataFrame([row], "i long, o long, a long")
    assert df.select(S.model_price(F.col("i"), F.col("o"), F.col("a"), F.lit(0.30), F.lit(2.50), F.lit(1.00))).first()[0] == cost
    assert df.select(S.model_price(F.col("i"), F.col("o"), F.col("a"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None))).first()[0] is None


def test_service_price(spark):
    one = spark.range(1)
    price = lambda kind, usage, key, rate: tuple(one.select(*S.service_price({kind: F.lit(usage)}, {key: F.lit(rate)})).first())
    assert price("minutes", 0.1, "usd_per_minute", 0.0043) == (0.00043, "minutes")
    assert price("characters", 250, "usd_per_million_chars", 20.0) == (0.005, "characters")
    assert price("count", 3, "usd_per_image", 0.0) == (0.0, "count")
    assert price("count", None, "usd_per_image", 0.001) == (None, "count")


def test_errors_and_templates(spark):
    assert apply(spark, T.is_permanent, ["402 Client Error", "429 wait", "500 x", "timed out", None]) == [True, False, False, False, False]
    assert apply(spark, lambda c: T.fill_template(c, a=F.lit("1")), ["{a}-{b}"]) == ["1-{b}"]
    assert SequenceMatcher(None, "tide", "diet").ratio() == 0.25
