"""Payloads of providers: usage counts, errors, emotion scores, billable minutes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that hold the input and the output count, in the order in which they are looked for.
INPUT_KEYS = ("prompt_token_count", "input_token_count", "input_tokens", "prompt_tokens")
OUTPUT_KEYS = ("candidates_token_count", "output_token_count", "output_tokens", "completion_tokens")
#: Status codes and words in messages of errors that another try can mend.
RETRYABLE_CODES = (408, 409, 425, 429, 500, 502, 503, 504, 529)
RETRYABLE_WORDS = (
    "503", "502", "504", "429", "unavailable", "overloaded", "temporarily", "timeout", "timed out", "deadline", "rate limit", "rate-limit", "resource exhausted",
    "connection reset", "connection aborted", "remote end closed", "internal server error", "bad gateway", "gateway timeout",
)
#: Status codes and words of errors that make a model useless for the whole run.
FATAL_CODES = (401, 403, 404)
FATAL_WORDS = (
    "http 401", "http 403", "http 404", "401 unauthorized", "403 forbidden", "404 not found", "unauthorized", "forbidden", "not authorized", "permission denied",
    "access denied", "access_denied", "invalid api key", "invalid_api_key", "api key not valid", "authentication",
)


def usage_counts(usage: Column) -> Column:
    """struct<input_tokens, output_tokens, audio_input_tokens> of a usage object as JSON: the first field that is a number counts; audio is the sum of the details of that modality."""
    first = lambda keys: F.coalesce(*[F.get_json_object(usage, f"$.{k}").try_cast("long") for k in keys])
    details = F.from_json(F.get_json_object(usage, "$.prompt_tokens_details"), "array<struct<modality:string,token_count:string>>")
    counts = F.filter(F.transform(F.filter(details, lambda d: F.upper(d["modality"]) == "AUDIO"), lambda d: d["token_count"].try_cast("long")), lambda n: n.isNotNull())
    audio = F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n))
    flat = [F.get_json_object(usage, f"$.{k}.audio_tokens").try_cast("long") for k in ("prompt_tokens_details", "input_tokens_details")]
    return F.struct(first(INPUT_KEYS).alias("input_tokens"), first(OUTPUT_KEYS).alias("output_tokens"), F.coalesce(audio, *flat).alias("audio_input_tokens"))


def error_kind(code: Column, message: Column) -> Column:
    """retryable, fatal or other. A retryable status or message is never fatal."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    again = F.coalesce(code.isin(*RETRYABLE_CODES), F.lit(False)) | has(RETRYABLE_WORDS)
    gone = F.coalesce(code.isin(*FATAL_CODES), F.lit(False)) | has(FATAL_WORDS)
    return F.when(again, "retryable").when(gone, "fatal").otherwise("other")


def contempt_reported(scores: Column) -> Column:
    """Whether a map of scores holds a value for contempt."""
    return F.coalesce(F.exists(F.map_entries(scores), lambda e: (F.lower(F.trim(e["key"])) == "contempt") & e["value"].isNotNull()), F.lit(False))


def top_emotion(scores: Column) -> Column:
    """struct<name, score> of the highest score, the first of equals; nulls where there is none."""
    some = F.filter(F.map_entries(scores), lambda e: e["value"].isNotNull())
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("score"))
    return F.aggregate(some, start, lambda best, e: F.when(best["score"].isNull() | (e["value"] > best["score"]), F.struct(e["key"].alias("name"), e["value"].alias("score"))).otherwise(best))


def emotion_payload(scores: Column, error: Column | None = None) -> Column:
    """The JSON text of scores with their top emotion; missing scores are written as null, an error only where there is one."""
    fields = [scores.alias("emotions"), top_emotion(scores).alias("top_emotion")]
    keep = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct(*fields), keep)
    return plain if error is None else F.when(error.isNull(), plain).otherwise(F.to_json(F.struct(*fields, error.alias("error")), keep))


def audio_minutes(duration: Column) -> Column:
    """Billable minutes of a duration in seconds, as text or number; null where it is none."""
    seconds = duration.try_cast("double")
    return F.when(~F.isnan(seconds), seconds / 60.0)


def modalities(text: Column, audio: Column, image: Column) -> Column:
    """What a request holds: text always, audio and image where they are given."""
    named = F.array(F.lit("text"), F.when(audio.isNotNull(), "audio"), F.when(image.isNotNull(), "image"))
    return F.filter(named, lambda x: x.isNotNull())
