"""Score maps, rates and rounding, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seven classes in the order of their numbers.
EMOTIONS = ("neutral", "happy", "sad", "surprise", "fear", "disgust", "anger")
#: Other spellings of a class.
LABEL_ALIASES = {"happiness": "happy", "happy": "happy", "sadness": "sad", "sad": "sad", "angry": "anger", "disgusted": "disgust"}
CLASS_ALIASES = {
    "anger": "anger", "angry": "anger", "disgust": "disgust", "disgusted": "disgust", "fear": "fear", "fearful": "fear", "afraid": "fear", "happy": "happy",
    "happiness": "happy", "neutral": "neutral", "sad": "sad", "sadness": "sad", "surprise": "surprise", "surprised": "surprise", "contempt": "contempt",
}
#: Price keys in the order in which they are looked for, with the kind of usage and its factor.
RATE_KEYS = (
    ("usd_per_minute", "minutes", 1.0), ("usd_per_hour", "minutes", 1 / 60), ("usd_per_second", "minutes", 60.0), ("usd_per_million_chars", "characters", 1e-6),
    ("usd_per_thousand_chars", "characters", 1e-3), ("usd_per_character", "characters", 1.0), ("usd_per_image", "count", 1.0), ("usd_per_thousand_images", "count", 1e-3), ("usd_per_request", "count", 1.0),
)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def label_name(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, EMOTIONS)), number.try_cast("int"))


def class_name(text: Column) -> Column:
    """The class of a spelling or number; null for contempt and unknown ones."""
    word = F.lower(F.trim(text))
    found = F.coalesce(literal_map(CLASS_ALIASES)[word], label_name(word))
    return F.when(found != "contempt", found)


#: Parts of a literal: whole quoted texts, the words that JSON spells otherwise, and single characters.
LITERAL = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|\bNone\b|\bTrue\b|\bFalse\b|\bnan\b|[^'"]"""


def coerce_scores(text: Column) -> Column:
    """map<string,double> from JSON or the literal form of a Python dictionary; values that are no numbers are null. True and False are 1 and 0, as they count there."""
    word = lambda t: F.when(t.isin("None", "nan"), "null").when(t == "True", "true").when(t == "False", "false").otherwise(t)
    plain = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0)), word), "")
    value = lambda v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
    return F.transform_values(F.from_json(plain, "map<string,string>"), lambda _, v: value(v))


def best_label(scores: Column, aliases: dict[str, str] | None = None) -> Column:
    """The label with the highest score, the first of equals; the empty text if there is none."""
    entries = F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull())
    first = F.aggregate(
        entries, F.struct(F.lit("").alias("key"), F.lit(None).cast("double").alias("value")),
        lambda best, e: F.when(best["value"].isNull() | (e["value"] > best["value"]), F.struct(e["key"].alias("key"), e["value"].alias("value"))).otherwise(best),
    )["key"]
    name = F.lower(F.trim(F.coalesce(first, F.lit(""))))
    return F.coalesce(literal_map(aliases)[name], name) if aliases else name


def project_scores(scores: Column, mapping: dict[str, str]) -> Column:
    """Scores under the class names of ``mapping``; unknown labels go, and of labels with one class the last stays."""
    names = literal_map(mapping)
    entries = F.filter(F.transform(F.map_entries(scores), lambda e: F.struct(names[e["key"]].alias("key"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
    merged = F.aggregate(
        entries, F.array().cast("array<struct<key:string,value:double>>"),
        lambda acc, e: F.array_append(F.filter(acc, lambda x: x["key"] != e["key"]), F.struct(e["key"].alias("key"), e["value"].alias("value"))),
    )
    return F.map_from_entries(merged)


def renormalize(scores: Column) -> Column:
    """Non-null scores divided by their sum; unchanged if that is not positive."""
    total = F.aggregate(F.filter(F.map_values(scores), lambda v: v.isNotNull()), F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.transform_values(scores, lambda _, v: v / total)).otherwise(scores)


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rounded(value: Column, places: int) -> Column:
    """Half-up rounding by way of decimals, so that engines agree on ties."""
    return F.round(value.cast("decimal(28,12)"), places).cast("double")


def confidence(text: Column) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def model_price(tokens_in: Column, tokens_out: Column, audio: Column, rate_in: Column, rate_out: Column, rate_audio: Column) -> Column:
    """USD of a model call by rates per million tokens, six places; null without a rate or any count. Audio tokens are part of the input."""
    heard = F.coalesce(audio, F.lit(0))
    text = F.greatest(F.coalesce(tokens_in, F.lit(0)) - heard, F.lit(0))
    exact = [n.cast("decimal(18,0)") * F.coalesce(r, F.lit(0.0)).cast("decimal(12,6)") for n, r in ((text, rate_in), (heard, F.coalesce(rate_audio, rate_in)), (F.coalesce(tokens_out, F.lit(0)), rate_out))]
    some = tokens_in.isNotNull() | tokens_out.isNotNull() | audio.isNotNull()
    priced = rate_in.isNotNull() | rate_out.isNotNull()
    return F.when(some & priced, F.round((exact[0] + exact[1] + exact[2]) * F.lit("0.000001").cast("decimal(7,6)"), 6).cast("double"))


def service_price(usage: dict[str, Column], rates: dict[str, Column]) -> tuple[Column, Column]:
    """USD of a service call and its unit: the first price key with a rate counts; null without its usage."""
    cost, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for key, kind, factor in reversed(RATE_KEYS):
        if key in rates:
            priced = rates[key].isNotNull()
            cost = F.when(priced, rounded(usage.get(kind, F.lit(None)).cast("double") * rates[key] * F.lit(factor), 6)).otherwise(cost)
            unit = F.when(priced, F.lit(kind)).otherwise(unit)
    return cost, unit
