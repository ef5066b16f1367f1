"""Domain tables derived from the supplied ones by whole-number arithmetic, in Spark and as SQL. They hold all rows and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.functions.scores import EMOTIONS
from quorumlens.functions.text import tokens
from quorumlens.session import spread, table

SERVICES = [f"svc_{k}" for k in range(6)]
MODELS = [f"m{m}" for m in range(3)]
NAMES_SQL = "[" + ", ".join(f"'{e}'" for e in EMOTIONS) + "]"


def each(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(n)])))


def label_panel(spark: SparkSession, sf: str) -> DataFrame:
    """id, service, svc_ord, reference, label and its payload, service_output."""
    e = each(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("l")), "svc_ord", 6)
    k, i, label = F.col("svc_ord"), F.col("id"), F.col("l")
    guess = F.when((i * 13 + k * 7) % 10 < 5 + k % 4, label % 7).otherwise((label + 1 + i % 6) % 7)
    names = F.array(*map(F.lit, EMOTIONS))
    said = F.when((i + k) % 29 == 0, "").otherwise(F.get(names, guess.cast("int")))
    rows = e.select("id", F.concat(F.lit("svc_"), k).alias("service"), "svc_ord", F.get(names, (label % 7).cast("int")).alias("reference"), said.alias("label"))
    return rows.withColumn("service_output", payload("label"))


def payload(label: str) -> Column:
    """A recorded answer around a label: blank, broken or reporting an error now and then."""
    i, k, x = F.col("id"), F.col("svc_ord"), F.col(label)
    return (
        F.when(x == "", "").when((i + k) % 31 == 0, F.concat(F.lit("{broken "), x)).when((i + k) % 37 == 0, F.lit('{"error":"no face"}'))
        .otherwise(F.concat(F.lit('{"emotions":{"'), x, F.lit('":0.9},"top_emotion":{"name":"'), x, F.lit('","score":0.9}}')))
    )


LABEL_PANEL = f"""label_panel AS (
  SELECT *, CASE WHEN label = '' THEN '' WHEN (id + svc_ord) % 31 = 0 THEN '{{broken ' || label WHEN (id + svc_ord) % 37 = 0 THEN '{{"error":"no face"}}'
                 ELSE '{{"emotions":{{"' || label || '":0.9}},"top_emotion":{{"name":"' || label || '","score":0.9}}}}' END AS service_output
  FROM (SELECT vec_id AS id, 'svc_' || k AS service, k::INT AS svc_ord, ({NAMES_SQL})[(label % 7) + 1] AS reference,
               CASE WHEN (vec_id + k) % 29 = 0 THEN ''
                    ELSE ({NAMES_SQL})[(CASE WHEN (vec_id*13 + k*7) % 10 < 5 + k % 4 THEN label % 7 ELSE (label + 1 + vec_id % 6) % 7 END) + 1] END AS label
        FROM embeddings, range(6) t(k)))"""


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """id, lang and text of every sentence of every conversation turn: whole texts, as a speech panel has them."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("at", "text"))
    lang = F.get(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("conv_id") % 4).cast("int"))
    rows = rows.select(((F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("at") + 1).cast("long").alias("id"), lang.alias("lang"), "text")
    return spread(rows, "id")  # a table of one file would be one task, and each row makes many comparisons


UTTERANCES = """(SELECT (conv_id::BIGINT * 1000 + turn) * 1000 + n AS id, (['de', 'en', 'es', 'fr'])[(conv_id % 4) + 1] AS lang, text
  FROM (SELECT conv_id, turn, unnest(s) AS text, generate_subscripts(s, 1) AS n
        FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM conversations)))"""


def text_panel(spark: SparkSession, sf: str, words: bool = False) -> DataFrame:
    """id, lang, service, svc_ord, human (the whole utterance) and service_output (with changed and missing words, blanks, errors). words: with those of the utterance as _human."""
    d = utterances(spark, sf).withColumn("w", tokens(F.col("text")))
    e = each(d, "svc_ord", 6)
    k, i = F.col("svc_ord"), F.col("id")
    changed = F.transform("w", lambda w, n: F.when((n + i) % (k + 4) == 0, F.concat(F.lit("w"), n.cast("string"))).otherwise(w))
    e = e.withColumn("c", changed)
    kept = F.array_join(F.filter("c", lambda w, n: (n + i + k) % (k + 5) != 0), " ")
    said = F.when((i * 7 + k) % 23 == 0, "").when((i + k) % 29 == 0, '{"error":"x"}').otherwise(kept)
    return e.select("id", "lang", F.concat(F.lit("svc_"), k).alias("service"), "svc_ord", F.col("text").alias("human"), said.alias("service_output"), *[F.col("w").alias("_human")] * words)


#: The words of a text in SQL.
TOKENS_SQL = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9'' ]+', ' ', 'g'), ' '), lambda w: w <> '')"
TEXT_PANEL = f"""text_panel AS (
  SELECT id, lang, 'svc_' || k AS service, k::INT AS svc_ord, text AS human,
         CASE WHEN (id*7 + k) % 23 = 0 THEN '' WHEN (id + k) % 29 = 0 THEN '{{"error":"x"}}'
              ELSE coalesce(array_to_string(list_filter(list_transform(w, lambda x, n: CASE WHEN (n - 1 + id) % (k + 4) = 0 THEN 'w' || (n - 1) ELSE x END), lambda x, n: (n - 1 + id + k) % (k + 5) <> 0), ' '), '') END AS service_output
  FROM (SELECT *, {TOKENS_SQL.format("text")} AS w FROM {UTTERANCES}), range(6) t(k))"""


def errors_sql(name: str, source: str, keys: str, reference: str = "human") -> str:
    """A table of errors and reference words: words become characters, as in the engine, but of one byte (an utterance has few different words)."""
    letters = "array_to_string(list_transform({0}, lambda w: chr((1 + list_position(v, w))::INT)), '')"
    return f"""{name}_known AS (SELECT *, list_distinct(list_concat(r, h)) AS v FROM (SELECT *, {TOKENS_SQL.format(reference)} AS r, {TOKENS_SQL.format("service_output")} AS h FROM {source})),
{name} AS (
  SELECT {keys}, len(r)::BIGINT AS {reference}_ref_words,
         (CASE WHEN len(r) = 0 THEN len(h) WHEN len(h) = 0 THEN len(r) ELSE levenshtein({letters.format("r")}, {letters.format("h")}) END)::BIGINT AS {reference}_errors
  FROM {name}_known)"""


ERRORS = f"{TEXT_PANEL},\n{errors_sql('errors', 'text_panel', 'id, lang, service, svc_ord')}"


def prompt_of(i: Column) -> Column:
    return F.when(i % 3 == 0, "short").when(i % 3 == 1, "medium").otherwise("medium__no-threshold")


PROMPT_OF = "CASE {0} % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'medium__no-threshold' END"


def oracle_answers(spark: SparkSession, sf: str, words: bool = False) -> DataFrame:
    """id, lang, prompt, model, human and answer: what each model itself heard; null where it gave no answer. words: with those of the utterance as _human."""
    d = each(utterances(spark, sf).withColumn("w", tokens(F.col("text"))), "m", 3)
    i, m = F.col("id"), F.col("m")
    heard = F.array_join(F.filter("w", lambda w, n: (n + 2 * i + m) % (m + 7) != 0), " ")
    return d.select("id", "lang", prompt_of(i).alias("prompt"), F.concat(F.lit("m"), m).alias("model"), F.col("text").alias("human"), F.when((i + m) % 41 != 0, heard).alias("answer"), *[F.col("w").alias("_human")] * words)


ORACLE_ANSWERS = f"""oracle_answers AS (
  SELECT id, lang, {PROMPT_OF.format("id")} AS prompt, 'm' || m AS model, m, text AS human,
         CASE WHEN (id + m) % 41 <> 0 THEN coalesce(array_to_string(list_filter(w, lambda x, n: (n - 1 + 2*id + m) % (m + 7) <> 0), ' '), '') END AS answer
  FROM (SELECT *, {TOKENS_SQL.format("text")} AS w FROM {UTTERANCES}), range(3) t(m))"""


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    """prompt, model, id, llm_label, winner, confidence (text) and scores (map of texts) of recorded answers."""
    d = each(utterances(spark, sf).select("id"), "m", 3)
    i, m = F.col("id"), F.col("m")
    prompt = prompt_of(i)
    winner = F.when((i + m) % 13 == 0, F.lit(None)).when((i + m) % 17 == 0, "").when((i + m) % 19 == 0, "nobody").otherwise(F.concat(F.lit("svc_"), (i * 5 + m) % 6))
    sure = F.when((i + m) % 11 == 0, F.lit(None)).when((i + m) % 23 == 0, "high").otherwise(F.format_string("0.%02d", (i * 13 + m * 29) % 100))
    pair = lambda k: F.struct(F.lit(f"svc_{k}"), F.when((i + k) % 17 == 0, "none").otherwise(F.format_string("0.%02d", (i * 31 + k * 17 + m * 11) % 100)))
    scores = F.map_from_entries(F.array(*[pair(k) for k in range(5)]))  # the last service is never rated
    return d.select(prompt.alias("prompt"), F.concat(F.lit("m"), m).alias("model"), "id", F.concat(F.lit("label"), i % 7).alias("llm_label"), winner.alias("winner"), sure.alias("confidence"), scores.alias("scores"))


JUDGEMENTS = f"""answers AS (
  SELECT CASE i % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'medium__no-threshold' END AS prompt, 'm' || m AS model, i AS id, m, 'label' || (i % 7) AS llm_label,
         CASE WHEN (i + m) % 13 = 0 THEN NULL WHEN (i + m) % 17 = 0 THEN '' WHEN (i + m) % 19 = 0 THEN 'nobody' ELSE 'svc_' || ((i*5 + m) % 6) END AS winner,
         CASE WHEN (i + m) % 11 = 0 THEN NULL WHEN (i + m) % 23 = 0 THEN 'high' ELSE '0.' || lpad(((i*13 + m*29) % 100)::VARCHAR, 2, '0') END AS confidence
  FROM (SELECT id AS i FROM {UTTERANCES}), range(3) t(m)),
judged AS (
  SELECT prompt, model, id, llm_label, CASE WHEN winner LIKE 'svc_%' THEN winner END AS winner, confidence, 'svc_' || k AS service,
         CASE WHEN k = 5 OR (id + k) % 17 = 0 THEN -1.0::DOUBLE ELSE ('0.' || lpad(((id*31 + k*17 + m*11) % 100)::VARCHAR, 2, '0'))::DOUBLE END AS score,
         coalesce(CASE WHEN winner LIKE 'svc_%' THEN winner END = 'svc_' || k, false) AS is_winner
  FROM answers, range(6) s(k))"""


def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of model calls."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    gone = n % 37 == 0
    return e.select(
        n.alias("call_id"), F.when(n % 2 == 0, "asr").otherwise("mt").alias("task"), F.col("event_type").alias("paradigm"), F.concat(F.lit("m"), F.col("user_id") % 4).alias("model"),
        F.when(gone, F.lit(None)).otherwise(n % 5000).alias("input_tokens"), F.when(gone, F.lit(None)).otherwise(n % 400).alias("output_tokens"),
        F.when(gone, F.lit(None)).when(n % 5 == 0, n % 1000).otherwise(0).alias("audio_input_tokens"), F.when(n % 11 == 0, "failed").when(n % 13 == 0, F.lit(None)).otherwise("success").alias("status"), (n % 977).cast("double").alias("latency_ms"),
    )


def model_prices(spark: SparkSession) -> DataFrame:
    rows = [("m0", 0.30, 2.50, 1.00), ("m1", 0.10, 0.40, None), ("m2", 0.15, 0.60, 0.70)]
    return spark.createDataFrame(rows, "model string, rate_in double, rate_out double, rate_audio double")


MODEL_CALLS = """prices(model, rin, rout, raudio) AS (VALUES ('m0', 30, 250, 100), ('m1', 10, 40, 10), ('m2', 15, 60, 70)),
calls AS (
  SELECT n AS call_id, CASE WHEN n % 2 = 0 THEN 'asr' ELSE 'mt' END AS task, event_type AS paradigm, 'm' || (user_id % 4) AS model,
         CASE WHEN n % 37 <> 0 THEN n % 5000 END AS input_tokens, CASE WHEN n % 37 <> 0 THEN n % 400 END AS output_tokens,
         CASE WHEN n % 37 = 0 THEN NULL WHEN n % 5 = 0 THEN n % 1000 ELSE 0 END AS audio_input_tokens,
         CASE WHEN n % 11 = 0 THEN 'failed' WHEN n % 13 = 0 THEN NULL ELSE 'success' END AS status, (n % 977)::DOUBLE AS latency_ms
  FROM (SELECT event_id AS n, event_type, user_id FROM events)),
ledger AS (
  SELECT calls.*, CASE WHEN input_tokens IS NOT NULL AND rin IS NOT NULL
           THEN round(((greatest(input_tokens - audio_input_tokens, 0)*rin + audio_input_tokens*raudio + output_tokens*rout)::DECIMAL(18,0) * 0.00000001::DECIMAL(18,8))::DECIMAL(28,8), 6)::DECIMAL(28,6) END AS cost
  FROM calls LEFT JOIN prices USING (model))"""


def service_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A ledger of service calls: whole units by task and service."""
    rows = table(spark, sf, "lineitem")
    task = F.get(F.array(F.lit("asr"), F.lit("mt"), F.lit("fer")), (F.col("l_suppkey") % 3).cast("int"))
    return rows.select(task.alias("task"), F.concat(F.lit("svc_"), F.col("l_suppkey") % 6).alias("service"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("usage"))


def service_prices(spark: SparkSession) -> DataFrame:
    rows = [("asr", "svc_0", 0.25, None, None), ("asr", "svc_3", None, None, 0.5), ("mt", "svc_1", None, 20.0, None), ("mt", "svc_4", None, 16.0, 1.0), ("fer", "svc_2", None, None, 0.001)]
    return spark.createDataFrame(rows, "task string, service string, usd_per_minute double, usd_per_million_chars double, usd_per_image double")


SERVICE_CALLS = """service_prices(task, service, rate, unit) AS (
  VALUES ('asr', 'svc_0', 250000, 'minutes'), ('asr', 'svc_3', 500000, 'count'), ('mt', 'svc_1', 20, 'characters'), ('mt', 'svc_4', 16, 'characters'), ('fer', 'svc_2', 1000, 'count')),
service_ledger AS (
  SELECT task, service, usage, unit, (usage::BIGINT * rate)::DECIMAL(28,6) / 1000000 AS cost
  FROM (SELECT (['asr', 'mt', 'fer'])[(l_suppkey % 3) + 1] AS task, 'svc_' || (l_suppkey % 6) AS service, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS usage FROM lineitem)
  LEFT JOIN service_prices USING (task, service))"""
