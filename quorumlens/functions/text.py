"""Text normalisation, JSON payloads and failure checks, as column expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that stand for a missing value.
NULL_WORDS = ("", "n/a", "na", "null", "none", "nan")


def normalize_id(value: Column) -> Column:
    """An id of four digits at least: trailing digits padded with zeros, else the text itself; null gives the empty text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^-?[0-9]+\.0$"), F.regexp_extract(text, r"^(-?[0-9]+)", 1)).otherwise(text)
    digits = F.regexp_extract(text, r"([0-9]+)$", 1)
    return F.when(digits == "", text).when(F.length(digits) <= 4, F.lpad(digits, 4, "0")).otherwise(digits)


def squeeze(text: Column) -> Column:
    """Outer white space removed, inner runs as one space; null gives the empty text."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")


def one_line(text: Column, limit: int) -> Column:
    return F.substring(squeeze(text), 1, limit)


def tokens(text: Column) -> Column:
    """Lower-case words of a-z, 0-9 and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block, or the text."""
    inner = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*`{3}(?:json)?\s*", ""), r"\s*`{3}\s*$", "")
    return F.when(text.rlike(r"(?s)^\s*`{3}.*`{3}\s*$"), inner).otherwise(text)


def json_fields(text: Column) -> Column:
    """A JSON object as a map of texts; null where it is none."""
    plain = strip_fence(text)
    return F.when(plain.rlike(r"(?s)^\s*\{"), F.from_json(plain, "map<string,string>"))


def answer(text: Column, key: str) -> Column:
    """The field of an answer: n/a where there is no object or no such key, null where its value is null."""
    fields = json_fields(text)
    return F.when(F.coalesce(F.map_contains_key(fields, key), F.lit(False)), fields[key]).otherwise(F.lit("n/a"))


def is_null_word(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*NULL_WORDS)


def is_nullish(text: Column) -> Column:
    """A missing value, or an object or list of nothing but missing values, however deep.

    Of a JSON text without its keys, its missing values and the marks between them, nothing is left.
    """
    is_json = F.coalesce(F.try_parse_json(text).isNotNull() & text.rlike(r"(?s)^\s*[{\[]"), F.lit(False))
    values = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', "")
    left = F.regexp_replace(F.regexp_replace(values, r'(?i)"\s*(?:n/a|na|null|none|nan)?\s*"|\bnull\b', ""), r"[\s{}\[\],]+", "")
    return F.when(is_json, left == "").otherwise(is_null_word(text))


def truthy(value: Column) -> Column:
    """Whether the JSON text of a field is neither missing nor empty, zero or false."""
    return ~F.coalesce(value, F.lit("")).isin("", "false", "0", "0.0", "{}", "[]", "null")


def is_failed_text(text: Column) -> Column:
    """Blank, or a JSON object that reports an error: a truthy error, success false, or a request id only."""
    fields = F.when(text.rlike(r"(?s)^\s*\{"), F.from_json(text, "map<string,string>"))
    envelope = F.map_contains_key(fields, "request_id") | F.map_contains_key(fields, "requestId")
    unsuccessful = F.coalesce(fields["success"] == "false", F.lit(False)) & ~text.rlike(r'"success"\s*:\s*"')
    return text.isNull() | (squeeze(text) == "") | F.coalesce(truthy(fields["error"]) & fields["error"].isNotNull() | unsuccessful | envelope, F.lit(False))


def top_label(payload: Column, fallback: str = "raw", other_keys: tuple[str, ...] = ("label_name", "label")) -> Column:
    """The top label of a payload, in lower case.

    fallback: what text that is no JSON object gives, ``raw`` (itself) or ``empty``. other_keys: fields that count, in order, where there is no top emotion.
    """
    is_object = F.try_parse_json(payload).isNotNull() & payload.rlike(r"(?s)^\s*\{")
    name = F.coalesce(F.get_json_object(payload, "$.top_emotion.name"), *[F.get_json_object(payload, f"$.{k}") for k in other_keys], F.lit(""))
    other = F.coalesce(payload, F.lit("")) if fallback == "raw" else F.lit("")
    return F.lower(F.trim(F.when(F.coalesce(is_object, F.lit(False)), name).otherwise(other)))


def is_failed_label(payload: Column) -> Column:
    """Blank, no JSON object, a truthy error, or no top label."""
    failed = truthy(F.get_json_object(payload, "$.error")) | (squeeze(F.get_json_object(payload, "$.top_emotion.name")) == "")
    is_object = F.coalesce(F.try_parse_json(payload).isNotNull() & payload.rlike(r"(?s)^\s*\{"), F.lit(False))
    return F.when(is_object, failed).otherwise(True)


def status_code(error: Column) -> Column:
    return F.regexp_extract(F.coalesce(error, F.lit("")), r"^\s*(\d{3})\b", 1).try_cast("int")


def is_permanent(error: Column, passing: tuple[int, ...] = (408, 425, 429)) -> Column:
    """A leading client-error status that another try won't change."""
    code = status_code(error)
    return F.coalesce(code.between(400, 499) & ~code.isin(*passing), F.lit(False))


def fill_template(template: Column, **values: Column) -> Column:
    """``{name}`` in the template replaced by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
