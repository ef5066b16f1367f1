"""The registered queries, one or more for each operator, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.functions import scores as S
from quorumlens.functions import text as T
from quorumlens.functions.similarity import matching_ratio, with_chrf
from quorumlens.functions import payloads as P
from quorumlens.operators import costs, failures, judging, metrics, panel, passes, reports, store, votes
from quorumlens.operators.quantiles import exact_percentiles
from quorumlens.operators.registry import OUTPUT_KINDS
from quorumlens.plans import fixtures as X
from quorumlens.session import spread, table, written
from quorumlens.sources import config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is any."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register



# Scalar functions

@query("""SELECT event_id, CASE WHEN d = '' THEN v WHEN length(d) <= 4 THEN lpad(d, 4, '0') ELSE d END AS norm
          FROM (SELECT event_id, v, regexp_extract(v, '([0-9]+)$', 1) AS d FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 'svc_' || event_id WHEN 2 THEN 'no digits' ELSE '' END AS v FROM events))""")
def q_norm_id(spark, sf):
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, F.concat(F.lit("svc_"), n)).when(n % 4 == 2, "no digits")
    return table(spark, sf, "events").select("event_id", T.normalize_id(raw).alias("norm"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, {X.TOKENS_SQL.format('text')} AS t FROM documents)")
def q_tokenize(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), 1, 40) AS line FROM documents""")
def q_oneline(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.one_line(F.col("text"), 40).alias("line"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 7)::VARCHAR WHEN 1 THEN NULL ELSE 'n/a' END AS answer FROM events""")
def q_fence_json(spark, sf):
    n = F.col("event_id")
    body = F.when(n % 4 == 0, F.concat(F.lit('{"transcript":"'), n % 7, F.lit('"}'))).when(n % 4 == 1, '{"transcript":null}').when(n % 4 == 2, '{"x":1}').otherwise("oops")
    return table(spark, sf, "events").select("event_id", T.answer(F.concat(F.lit("```json\n"), body, F.lit("\n```")), "transcript").alias("answer"))


NULLISH = ["", " N/A ", "None", "nan", "{}", "[]", '{"a":null,"b":"na"}', "no", '{"a":0}', "0", "[null]", '["x"]']


@query("SELECT event_id, (event_id % 13) NOT IN (7, 8, 9, 11) AS nullish FROM events")
def q_nullish(spark, sf):
    value = F.get(F.array(*map(F.lit, NULLISH)), (F.col("event_id") % 13).cast("int"))
    return table(spark, sf, "events").select("event_id", T.is_nullish(value).alias("nullish"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 400 + event_id % 40 ELSE -1 END AS code, coalesce(event_id % 5 = 0 AND (400 + event_id % 40) NOT IN (408, 425, 429), false) AS permanent FROM events")
def q_error_class(spark, sf):
    n = F.col("event_id")
    error = F.when(n % 5 == 0, F.concat(F.lit(" "), 400 + n % 40, F.lit(" Client Error"))).when(n % 5 == 1, "timed out")
    return table(spark, sf, "events").select("event_id", F.coalesce(T.status_code(error), F.lit(-1)).cast("long").alias("code"), T.is_permanent(error).alias("permanent"))


@query("SELECT doc_id, 'Translate from ' || lang || ': ' || text AS prompt FROM documents")
def q_prompt_fill(spark, sf):
    filled = T.fill_template(F.lit("Translate from {lang}: {source_text}"), lang=F.col("lang"), source_text=F.col("text"))
    return table(spark, sf, "documents").select("doc_id", filled.alias("prompt"))



# Scores of classes

@query("""SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN '' WHEN a >= b THEN 'happy' ELSE 'anger' END AS label FROM (SELECT vec_id, vec_id % 10 AS a, label AS b FROM embeddings)""")
def q_score_argmax(spark, sf):
    i = F.col("vec_id")
    text = F.when(i % 11 == 0, "{'happiness': None}").otherwise(F.concat(F.lit("{'happiness': 0."), i % 10, F.lit(", 'angry': 0."), F.col("label"), F.lit(", 'sad': None}")))
    return table(spark, sf, "embeddings").select("vec_id", S.best_label(S.coerce_scores(text), S.LABEL_ALIASES).alias("label"))


@query("SELECT vec_id, (vec_id % 10)::DOUBLE AS neutral, 0.5::DOUBLE AS happy, 2::BIGINT AS n FROM embeddings")
def q_emotion_project(spark, sf):
    scores = F.create_map(F.lit("calm"), F.lit(0.25), F.lit("happy"), F.lit(0.5), F.lit("other"), F.lit(1.0), F.lit("confused"), (F.col("vec_id") % 10).cast("double"))
    out = S.project_scores(scores, {"calm": "neutral", "confused": "neutral", "happy": "happy"})
    return table(spark, sf, "embeddings").select("vec_id", out["neutral"].alias("neutral"), out["happy"].alias("happy"), F.size(out).cast("long").alias("n"))


@query("SELECT vec_id, CASE WHEN t > 0 THEN a / t ELSE a END AS a, CASE WHEN t > 0 THEN b / t ELSE b END AS b FROM (SELECT vec_id, (vec_id % 4)::DOUBLE AS a, (label % 3)::DOUBLE AS b, (vec_id % 4 + label % 3)::DOUBLE AS t FROM embeddings)")
def q_renormalize(spark, sf):
    scores = F.create_map(F.lit("a"), (F.col("vec_id") % 4).cast("double"), F.lit("b"), (F.col("label") % 3).cast("double"), F.lit("c"), F.lit(None).cast("double"))
    out = S.renormalize(scores)
    return table(spark, sf, "embeddings").select("vec_id", out["a"].alias("a"), out["b"].alias("b"))



# Failures

@query(f"""WITH {X.TEXT_PANEL} SELECT 'asr' AS task, service, count(*) AS total_inputs, count(*) FILTER (WHERE trim(service_output) = '' OR service_output LIKE '{{"error"%') AS failed_inputs,
           round((count(*) FILTER (WHERE trim(service_output) = '' OR service_output LIKE '{{"error"%'))::DECIMAL(18,6) / count(*), 4)::DOUBLE AS failure_rate FROM text_panel GROUP BY service""")
def q_failure_text(spark, sf):
    return failures.failure_report(X.text_panel(spark, sf), "asr", "text")


LABEL_FAILURES = f"""WITH {X.LABEL_PANEL}, f AS (SELECT service, count(*) AS total_inputs, count(*) FILTER (WHERE service_output = '' OR service_output LIKE '{{broken%' OR service_output LIKE '{{"error"%') AS failed_inputs FROM label_panel GROUP BY service)
           SELECT 'fer' AS task, service, total_inputs, failed_inputs, round(failed_inputs::DECIMAL(18,6) / total_inputs, 4)::DOUBLE AS failure_rate FROM f"""


@query(LABEL_FAILURES)
def q_failure_label(spark, sf):
    return failures.failure_report(X.label_panel(spark, sf), "fer", "emotion")


@query(LABEL_FAILURES + " UNION ALL SELECT 'mt', 'svc_0', 10, 1, 0.1::DOUBLE")
def q_failure_combined(spark, sf):
    old = spark.createDataFrame([("fer", "svc_0", 5, 5, 1.0), ("mt", "svc_0", 10, 1, 0.1)], "task string, service string, total_inputs long, failed_inputs long, failure_rate double")
    return failures.combined_report(old, failures.failure_report(X.label_panel(spark, sf), "fer", "emotion"), "fer")



# Word error rates

@query(f"WITH {X.ERRORS} SELECT id, lang, service, svc_ord, human_errors, human_ref_words, CASE WHEN human_ref_words > 0 THEN human_errors / human_ref_words::DOUBLE END AS human_wer FROM errors")
def q_wer_rows(spark, sf):
    return metrics.word_error_rows(X.text_panel(spark, sf, words=True))


WER = "sum(human_errors)::BIGINT AS errors, sum(human_ref_words)::BIGINT AS ref_words, count(*) AS n_samples, sum(human_errors)::DOUBLE / nullif(sum(human_ref_words), 0) AS wer"


@query(f"WITH {X.ERRORS} SELECT service, {WER} FROM errors GROUP BY service")
def q_wer_summary(spark, sf):
    return metrics.word_error_rate(q_wer_rows(spark, sf), "service")


@query(f"WITH {X.ERRORS} SELECT lang, service, {WER} FROM errors GROUP BY lang, service")
def q_wer_by_lang(spark, sf):
    return metrics.word_error_rate(q_wer_rows(spark, sf), "lang", "service")



# Classification

@query(f"WITH {X.LABEL_PANEL} SELECT id, service, svc_ord, reference, label, service_output, (reference <> '' AND reference = label)::INT AS correct FROM label_panel")
def q_fer_rows(spark, sf):
    return metrics.label_rows(X.label_panel(spark, sf))


def confusion_sql(source: str, by: str, classes: str) -> str:
    return f"""counts AS (SELECT {by}c AS class, count(*) FILTER (WHERE reference = c AND label = c) AS tp, count(*) FILTER (WHERE reference <> c AND label = c) AS fp,
        count(*) FILTER (WHERE reference = c AND label <> c) AS fn, count(*) FILTER (WHERE reference = c) AS support FROM {source}, unnest({classes}) u(c) WHERE reference <> '' GROUP BY {by}c),
      per_class AS (SELECT *, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM counts),
      scored AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM per_class)"""


@query(f"WITH {X.LABEL_PANEL}, {confusion_sql('label_panel', 'service, ', X.NAMES_SQL)} SELECT * FROM scored")
def q_fer_confusion(spark, sf):
    return metrics.class_scores(metrics.confusion(metrics.label_rows(X.label_panel(spark, sf)), "service"))


SUMMARY = """sum(support)::BIGINT AS n, sum(tp) / nullif(sum(support), 0)::DOUBLE AS accuracy, round(avg(coalesce(f1, 0)) FILTER (WHERE support > 0), 9) AS macro_f1,
      2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::DOUBLE AS micro_f1, round(sum(coalesce(f1, 0) * support) / nullif(sum(support), 0), 9) AS weighted_f1"""


def nine_places(df: DataFrame) -> DataFrame:
    """Averages of doubles to nine places: sums differ in the last bit with their order."""
    return df.withColumns({c: F.round(c, 9) for c in ("macro_f1", "weighted_f1") if c in df.columns})


@query(f"WITH {X.LABEL_PANEL}, {confusion_sql('label_panel', 'service, ', X.NAMES_SQL)} SELECT service, {SUMMARY} FROM scored GROUP BY service")
def q_fer_summary(spark, sf):
    return nine_places(metrics.classification_summary(metrics.label_rows(X.label_panel(spark, sf)), "service"))


@query(f"""WITH rows AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS reference, CASE WHEN n_chars > 600 THEN 'good' ELSE 'bad' END AS label FROM labels JOIN documents USING (doc_id)),
           {confusion_sql('rows', '', "['good', 'bad']")} SELECT {SUMMARY} FROM scored""")
def q_binary_quality_f1(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    good = lambda c: F.when(c, "good").otherwise("bad")
    return nine_places(metrics.classification_summary(rows.select(good(F.col("quality") == 1).alias("reference"), good(F.col("n_chars") > 600).alias("label")), classes=("good", "bad")))



# Disagreement and votes

VOTES = f"""WITH {X.LABEL_PANEL}, votes AS (SELECT id, label, count(*) AS n, min(svc_ord) AS o FROM label_panel WHERE label <> '' GROUP BY id, label),
    voters AS (SELECT id, count(*) FILTER (WHERE label <> '') AS voters, count(*) FILTER (WHERE label = '') AS blank FROM label_panel GROUP BY id),
    best AS (SELECT id, first(label ORDER BY n DESC, o) AS label, max(n) AS n FROM votes GROUP BY id),
    sds AS (SELECT id, CASE WHEN voters >= 2 THEN round(1 - n::DECIMAL(18,12) / voters, 6)::DOUBLE ELSE 0.0::DOUBLE END AS discrimination FROM voters LEFT JOIN best USING (id)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY discrimination DESC, id) AS rank FROM sds)"""


def _labels(spark, sf) -> DataFrame:
    return X.label_panel(spark, sf).withColumn("service_output", F.col("label"))


@query(f"{VOTES} SELECT id, discrimination, rank FROM ranked")
def q_sds_label(spark, sf):
    return votes.ranked(votes.label_disagreement(_labels(spark, sf)))


@query(f"{VOTES} SELECT id FROM ranked WHERE rank <= 25")
def q_sds_topk(spark, sf):
    return votes.top_ids(votes.label_disagreement(_labels(spark, sf)), 25)


@query(f"{VOTES} SELECT rank, id, sum(round(discrimination * 1000000)::BIGINT) OVER (ORDER BY rank)::DOUBLE / sum(round(discrimination * 1000000)::BIGINT) OVER () AS coverage FROM ranked")
def q_sds_curve(spark, sf):
    return votes.coverage_curve(votes.label_disagreement(_labels(spark, sf)))


@query(f"{VOTES} SELECT id, service, label FROM label_panel WHERE id IN (SELECT id FROM ranked WHERE rank <= 25)")
def q_sds_filter(spark, sf):
    rows = _labels(spark, sf)
    return rows.join(votes.top_ids(votes.label_disagreement(rows), 25), "id", "left_semi").select("id", "service", "label")


@query()
def q_sds_text(spark, sf):
    return votes.text_disagreement(X.text_panel(spark, sf))


@query(f"""{VOTES} SELECT id, coalesce(label, '') AS mv_label, coalesce(n, blank) AS votes, voters, CASE WHEN voters > 0 THEN round(n::DECIMAL(18,12) / voters, 4)::DOUBLE ELSE 0.0::DOUBLE END AS agreement FROM voters LEFT JOIN best USING (id)""")
def q_mode_vote(spark, sf):
    return votes.mode_vote(_labels(spark, sf))


@query()
def q_medoid_text(spark, sf):
    return votes.medoid_vote(X.text_panel(spark, sf))


@query(f"WITH {X.LABEL_PANEL} SELECT id, " + ", ".join(f"max(label) FILTER (WHERE service = '{s}') AS ballot__{s}" for s in X.SERVICES) + " FROM label_panel GROUP BY id")
def q_vote_wide(spark, sf):
    return panel.wide(_labels(spark, sf), X.SERVICES)


@query(f"WITH {X.LABEL_PANEL} SELECT id, string_agg(service || ': ' || label, chr(10) ORDER BY svc_ord) AS service_blocks FROM label_panel GROUP BY id")
def q_service_block(spark, sf):
    return panel.service_block(_labels(spark, sf))


@query("""SELECT vec_id AS id, 'svc_' || k AS service, k::INT AS svc_ord, CASE WHEN (vec_id + k) % 3 = 0 THEN '' ELSE 'said ' || k END AS service_output FROM embeddings, range(6) t(k)""")
def q_panel_join(spark, sf):
    samples = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    outputs = X.each(samples, "k", 6).filter("(id + k) % 3 <> 0").select("id", F.concat(F.lit("svc_"), "k").alias("service"), F.concat(F.lit("said "), "k").alias("service_output"))
    return panel.complete_panel(samples, X.SERVICES, outputs)


@query()
def q_similarity_pairs(spark, sf):
    """Each benchmark item against the next one: a pair a row."""
    items = table(spark, sf, "benchmark")
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return pairs.select("item_id", F.round(matching_ratio("text", "other"), 6).alias("ratio"))


@query()
def q_comet_surrogate(spark, sf):
    rows = with_chrf(X.text_panel(spark, sf), "human", "service_output")
    return rows.groupBy("service").agg(F.round(F.avg("chrf"), 6).alias("chrf"), F.count(F.lit(1)).alias("n_samples"))



# Judgements

@query(f"WITH {X.JUDGEMENTS} SELECT prompt, model, id, llm_label, winner, confidence, service, score, is_winner FROM judged")
def q_judge_long(spark, sf):
    return judging.judge_rows(X.judgements(spark, sf), X.SERVICES)


@query(f"WITH {X.JUDGEMENTS}, g AS (SELECT prompt, model, id, bool_or(score >= 0) AS rated, any_value(winner) AS winner FROM judged GROUP BY prompt, model, id) SELECT prompt, model, id, coalesce(rated AND winner IS NOT NULL, false) AS usable FROM g")
def q_judge_usable(spark, sf):
    a = X.judgements(spark, sf)
    return a.select("prompt", "model", "id", judging.usable(F.col("winner"), F.col("scores"), F.array(*map(F.lit, X.SERVICES))).alias("usable"))


BEST = f"""{X.ERRORS}, wer AS (SELECT id, service, svc_ord, human_errors::DOUBLE / human_ref_words AS human_wer FROM errors WHERE human_ref_words > 0),
    sets AS (SELECT id, list_sort(list(DISTINCT service)) AS best FROM (SELECT *, min(human_wer) OVER (PARTITION BY id) AS low FROM wer) WHERE human_wer = low GROUP BY id),
    firsts AS (SELECT id, first(service ORDER BY human_wer, svc_ord) AS best_service FROM wer GROUP BY id)"""


@query(f"WITH {BEST} SELECT id, array_to_string(best, ',') AS best FROM sets")
def q_best_services(spark, sf):
    return judging.best_sets(q_wer_rows(spark, sf), "human_wer", False, "id").select("id", F.array_join("best", ",").alias("best"))


def _winners(spark, sf) -> DataFrame:
    """One row an answer, an unknown winner as null."""
    return judging.known_winners(X.judgements(spark, sf).drop("scores"), X.SERVICES)


@query(f"""WITH {BEST}, {X.JUDGEMENTS}, w AS (SELECT a.prompt, a.model, coalesce(list_contains(best, winner), false)::INT AS ok FROM (SELECT DISTINCT prompt, model, id, winner FROM judged WHERE winner IS NOT NULL) a LEFT JOIN sets USING (id))
           SELECT prompt, model, sum(ok)::DOUBLE / count(*) AS agreement, count(*) AS n FROM w GROUP BY prompt, model""")
def q_winner_correct(spark, sf):
    sets = judging.best_sets(q_wer_rows(spark, sf), "human_wer", False, "id")
    return judging.winner_agreement(_winners(spark, sf), sets, "prompt", "model")


@query(f"""WITH {X.JUDGEMENTS}, w AS (SELECT prompt, model, winner, count(*) AS n_wins FROM (SELECT DISTINCT prompt, model, id, winner FROM judged WHERE winner IS NOT NULL) GROUP BY prompt, model, winner)
           SELECT *, n_wins::DOUBLE / sum(n_wins) OVER (PARTITION BY prompt, model) AS win_rate FROM w""")
def q_win_rate(spark, sf):
    return judging.win_rates(_winners(spark, sf))


RESOLVED = f"""{BEST}, {X.JUDGEMENTS}, humans AS (SELECT id, any_value(human) AS human_label FROM text_panel GROUP BY id),
    resolved AS (SELECT a.prompt, a.model, a.id, a.llm_label, CASE WHEN winner LIKE 'svc_%' THEN winner END AS winner, human_label, best_service, coalesce(TRY_CAST(confidence AS DOUBLE), 0.0) AS confidence,
                        coalesce(TRY_CAST(confidence AS DOUBLE), 0.0) < 0.85 AS fallback_used FROM answers a LEFT JOIN humans USING (id) LEFT JOIN firsts USING (id))"""


def _resolved(spark, sf) -> DataFrame:
    human = X.utterances(spark, sf).select("id", F.col("text").alias("human_label"))
    best = judging.best_service(q_wer_rows(spark, sf), "human_wer", False, "id")
    return judging.with_fallback(_winners(spark, sf), human, best)


@query(f"""WITH {RESOLVED} SELECT prompt, model, id, confidence, fallback_used, CASE WHEN fallback_used AND coalesce(human_label, '') <> '' THEN human_label ELSE llm_label END AS final_label,
           CASE WHEN fallback_used THEN CASE WHEN coalesce(human_label, '') <> '' THEN best_service END ELSE winner END AS final_winner FROM resolved""")
def q_human_loop_resolve(spark, sf):
    return _resolved(spark, sf).select("prompt", "model", "id", "confidence", "fallback_used", "final_label", "final_winner")


@query(f"WITH {RESOLVED} SELECT prompt, model, avg(fallback_used::INT)::DOUBLE AS fallback_rate FROM resolved GROUP BY prompt, model")
def q_fallback_rate(spark, sf):
    return judging.fallback_rates(_resolved(spark, sf))


@query(f"""WITH {X.JUDGEMENTS} SELECT CASE WHEN grouping(prompt) = 1 THEN 'all_prompts' ELSE 'per_prompt' END AS scope, CASE WHEN grouping(prompt) = 1 THEN '<all>' ELSE prompt END AS prompt, model, service, count(*) AS n,
           round(avg(score), 9) AS mean, round(coalesce(stddev_samp(score), 0), 9) AS std, min(score) AS low, round(quantile_cont(score, 0.25), 9) AS p25, round(quantile_cont(score, 0.5), 9) AS median, round(quantile_cont(score, 0.75), 9) AS p75, max(score) AS high
           FROM judged WHERE score >= 0 GROUP BY GROUPING SETS ((prompt, model, service), (model, service))""")
def q_score_dist(spark, sf):
    d = judging.score_distribution(q_judge_long(spark, sf))
    return d.withColumns({c: F.round(c, 9) for c in ("mean", "std", "p25", "median", "p75")})


@query(f"""WITH {X.JUDGEMENTS} SELECT model, prompt, len(list_filter(range(1, 20), lambda k: k * 0.05::DOUBLE <= v))::BIGINT AS bin, count(*) AS n
           FROM (SELECT *, TRY_CAST(confidence AS DOUBLE) AS v FROM answers) WHERE v BETWEEN 0 AND 1 GROUP BY ALL""")
def q_conf_hist(spark, sf):
    """All confidences, edges too, by model and prompt."""
    return judging.histogram(X.judgements(spark, sf).withColumn("value", F.col("confidence").try_cast("double")), "value", "model", "prompt")


@query(f"""WITH {X.JUDGEMENTS}, b AS (SELECT service, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM judged WHERE score >= 0 GROUP BY service)
           SELECT service, round(any_value(q1), 9) AS q1, round(any_value(q3), 9) AS q3, count(*) FILTER (WHERE score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS outliers FROM judged JOIN b USING (service) WHERE score >= 0 GROUP BY service""")
def q_box_stats(spark, sf):
    rated = q_judge_long(spark, sf).filter("score >= 0")
    box = exact_percentiles(rated, ["service"], "score", {"q1": 0.25, "q3": 0.75}).drop("n")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("score") < F.col("q1") - reach) | (F.col("score") > F.col("q3") + reach)
    return rated.join(box, "service").groupBy("service").agg(F.round(F.first("q1"), 9).alias("q1"), F.round(F.first("q3"), 9).alias("q3"), F.count_if(out).alias("outliers"))


@query(f"""WITH {X.JUDGEMENTS} SELECT CASE WHEN prompt LIKE '%\\_\\_no-threshold' ESCAPE '\\' THEN 'no-threshold' ELSE 'threshold' END AS kind, replace(prompt, '__no-threshold', '') AS plain, count(*) AS n FROM answers GROUP BY ALL""")
def q_prompt_partition(spark, sf):
    kind, plain = judging.split_prompt(F.col("prompt"))
    return X.judgements(spark, sf).groupBy(kind.alias("kind"), plain.alias("plain")).agg(F.count(F.lit(1)).alias("n"))



# Reports

LLM_ROWS = X.ORACLE_ANSWERS + ",\nllm_in AS (SELECT id, prompt, model, human, coalesce(answer, '') AS service_output FROM oracle_answers),\n" + X.errors_sql("llm_errors", "llm_in", "id, prompt, model")
LLM_WER = "llm_wer AS (SELECT *, CASE WHEN human_ref_words > 0 THEN human_errors::DOUBLE / human_ref_words END AS human_wer FROM llm_errors)"
#: The services' outputs against each model's own answers: one row for each service and answer.
REF_ROWS = "ref_in AS (SELECT p.id, p.service, o.prompt, o.model, coalesce(o.answer, '') AS oracle, p.service_output FROM text_panel p JOIN oracle_answers o USING (id)),\n" + X.errors_sql("ref_errors", "ref_in", "id, service, prompt, model", "oracle")
SUMMARY_WER = """summary AS (SELECT prompt, model, service, sum(human_errors)::DOUBLE / nullif(sum(human_ref_words), 0) AS human_wer, sum(oracle_errors)::DOUBLE / nullif(sum(oracle_ref_words), 0) AS oracle_wer, count(*) AS n_samples
    FROM ref_errors JOIN errors USING (id, service) GROUP BY prompt, model, service)"""
LLM_SUMMARY = "llm_summary AS (SELECT prompt, model, sum(human_errors)::DOUBLE / nullif(sum(human_ref_words), 0) AS human_wer FROM llm_errors GROUP BY prompt, model)"
ACCURACY = f"{X.ERRORS},\n{LLM_ROWS},\n{REF_ROWS},\n{SUMMARY_WER},\n{LLM_SUMMARY}"


def _llm_rows(spark, sf) -> DataFrame:
    """The models' own answers scored as one more service."""
    answers = X.oracle_answers(spark, sf, words=True).withColumnRenamed("answer", "llm_oracle")
    return metrics.word_error_rows(passes.as_service(answers).drop("llm_oracle"))


def _summary(spark, sf) -> DataFrame:
    """Error rates of each (prompt, model, service) against the human and the model's own answer."""
    own = X.oracle_answers(spark, sf).select("id", "prompt", "model", F.coalesce("answer", F.lit("")).alias("oracle"))
    return reports.accuracy_summary(metrics.error_rows_by_answer(X.text_panel(spark, sf, words=True), own), "prompt", "model", "service")


def _llm_summary(spark, sf) -> DataFrame:
    return metrics.word_error_rate(_llm_rows(spark, sf), "prompt", "model").select("prompt", "model", F.col("wer").alias("human_wer"))


@query(f"""WITH {X.ERRORS},\n{LLM_ROWS},\n{LLM_WER} SELECT service AS entity, 'service' AS kind, round(avg(human_errors::DOUBLE / human_ref_words) FILTER (WHERE human_ref_words > 0), 9) AS value FROM errors GROUP BY service
           UNION ALL SELECT 'llm:' || model, 'llm', round(avg(human_wer), 9) FROM llm_wer GROUP BY model""")
def q_entity_accuracy(spark, sf):
    found = reports.entity_accuracy(q_wer_rows(spark, sf), _llm_rows(spark, sf), "human_wer")
    return found.select("entity", "kind", F.round("value", 9).alias("value"))


@query(f"WITH {ACCURACY} SELECT prompt, model, service, human_wer, oracle_wer, n_samples FROM summary")
def q_accuracy_summary(spark, sf):
    return _summary(spark, sf)


@query(f"""WITH {ACCURACY} SELECT service AS entity, '<all>' AS prompt, round(avg(human_wer), 9) AS value FROM summary WHERE human_wer IS NOT NULL GROUP BY service
           UNION ALL SELECT 'llm:' || model, prompt, round(avg(human_wer), 9) FROM llm_summary WHERE human_wer IS NOT NULL GROUP BY model, prompt""")
def q_accuracy_by_prompt(spark, sf):
    found = reports.accuracy_by_prompt(_summary(spark, sf), _llm_summary(spark, sf))
    return found.select("entity", "prompt", F.round("value", 9).alias("value"))


@query(f"WITH {ACCURACY} SELECT model, service, prompt, round(avg(oracle_wer), 9) AS value FROM summary GROUP BY ALL")
def q_accuracy_vs_llm(spark, sf):
    return reports.accuracy_vs_reference(_summary(spark, sf)).withColumn("value", F.round("value", 9))


def _cut_sql(hue: str) -> str:
    model, prompt = ("model", "'-'") if hue == "model" else ("'-'", "prompt")
    everything = ("'<all>'", "'-'") if hue == "model" else ("'-'", "'<all>'")
    return f"""SELECT 'by_{hue}' AS cut, service, {everything[0]} AS model, {everything[1]} AS prompt, 'human' AS reference, round(avg(human_wer), 9) AS value FROM summary GROUP BY service
               UNION ALL SELECT 'by_{hue}', service, {model}, {prompt}, 'oracle', round(avg(oracle_wer), 9) FROM summary GROUP BY service, {hue}"""


@query(f"""WITH {ACCURACY} SELECT 'all' AS cut, service, '-' AS model, '-' AS prompt, 'human' AS reference, round(avg(human_wer), 9) AS value FROM summary GROUP BY service
           UNION ALL SELECT 'all', service, '-', '-', 'oracle', round(avg(oracle_wer), 9) FROM summary GROUP BY service UNION ALL {_cut_sql("model")} UNION ALL {_cut_sql("prompt")}""")
def q_consistency_oracle_human(spark, sf):
    """Human beside oracle reference: altogether, by model and by prompt."""
    summary = written(_summary(spark, sf))  # a row for each (prompt, model, service), read five times
    cuts = [reports.reference_consistency(summary, *hue).withColumns({"cut": F.lit(name)} | {c: F.lit("-") for c in ("model", "prompt") if c not in hue}) for name, hue in (("all", ()), ("by_model", ("model",)), ("by_prompt", ("prompt",)))]
    columns = ["cut", "service", "model", "prompt", "reference", F.round("value", 9).alias("value")]
    return cuts[0].select(*columns).unionByName(cuts[1].select(*columns)).unionByName(cuts[2].select(*columns))


@query(f"WITH {ACCURACY} SELECT model, prompt, round(human_wer, 9) AS value FROM llm_summary")
def q_llmaas_by_model(spark, sf):
    return _llm_summary(spark, sf).select("model", "prompt", F.round("human_wer", 9).alias("value"))


@query(f"WITH {ACCURACY} SELECT round(min(oracle_wer), 9) AS low, round(max(oracle_wer), 9) AS high, count(DISTINCT prompt) AS n_prompt, count(DISTINCT model) AS n_model FROM summary")
def q_report_range(spark, sf):
    """Axis range of a report, and what it averages over."""
    summary = written(_summary(spark, sf))  # a row for each (prompt, model, service), read twice
    span = reports.value_range(summary, "oracle_wer").select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))
    return span.crossJoin(reports.different(summary, "prompt", "model"))  # one row each


@query(f"WITH {X.ERRORS} SELECT service, id, 'errors' AS measure, human_errors AS value FROM errors UNION ALL SELECT service, id, 'ref_words', human_ref_words FROM errors")
def q_ref_melt(spark, sf):
    rows = q_wer_rows(spark, sf).select("service", "id", F.col("human_errors").alias("errors"), F.col("human_ref_words").alias("ref_words"))
    return rows.unpivot(["service", "id"], ["errors", "ref_words"], "measure", "value")


@query(f"WITH {X.ERRORS} SELECT service, " + ", ".join(f"round(avg(human_errors::DOUBLE) FILTER (WHERE lang = '{x}'), 9) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM errors GROUP BY service")
def q_ref_pivot(spark, sf):
    langs = ["de", "en", "es", "fr"]
    wide = q_wer_rows(spark, sf).groupBy("service").pivot("lang", langs).agg(F.avg("human_errors"))
    return wide.select("service", *[F.round(x, 9).alias(x) for x in langs])



# Costs

@query(f"WITH {X.MODEL_CALLS} SELECT call_id, model, cost::DOUBLE AS cost_usd FROM ledger")
def q_llm_cost_rows(spark, sf):
    return _ledger(spark, sf).select("call_id", "model", "cost_usd")


def _ledger(spark, sf) -> DataFrame:
    return costs.priced_model_calls(X.model_calls(spark, sf), X.model_prices(spark))


@query(f"""WITH {X.MODEL_CALLS} SELECT task, paradigm, model, status, count(*) AS calls, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
           coalesce(sum(cost), 0)::DOUBLE AS cost_usd, round((sum(latency_ms::BIGINT)::DECIMAL(18,8) / count(*)), 2)::DOUBLE AS latency_ms FROM ledger GROUP BY task, paradigm, model, status""")
def q_llm_cost_summary(spark, sf):
    return costs.model_summary(_ledger(spark, sf))


@query(f"WITH {X.MODEL_CALLS} SELECT model, sum(cost)::DOUBLE AS total_usd, coalesce(sum(cost) FILTER (WHERE coalesce(status, 'success') = 'success'), 0)::DOUBLE AS successful_usd FROM ledger WHERE cost >= 0 GROUP BY model")
def q_cost_by_model(spark, sf):
    return costs.cost_by_model(_ledger(spark, sf))


def _service_ledger(spark, sf) -> DataFrame:
    return costs.priced_service_calls(X.service_calls(spark, sf), X.service_prices(spark))


@query(f"WITH {X.SERVICE_CALLS} SELECT task, service, count(*) AS calls, coalesce(sum(usage), 0)::DOUBLE AS usage, coalesce(sum(cost), 0)::DOUBLE AS cost_usd FROM service_ledger GROUP BY task, service")
def q_service_cost(spark, sf):
    return costs.service_summary(_service_ledger(spark, sf))


@query(f"""WITH {X.MODEL_CALLS}, {X.SERVICE_CALLS}, u AS (SELECT 'llm:' || model AS entity, cost FROM ledger UNION ALL SELECT service, cost FROM service_ledger)
           SELECT entity, coalesce(sum(cost), 0)::DOUBLE AS cost_usd, round(coalesce(sum(cost), 0)::DOUBLE / nullif(sum(coalesce(sum(cost), 0)) OVER (), 0)::DOUBLE, 9) AS share FROM u GROUP BY entity""")
def q_total_cost(spark, sf):
    return costs.invocation_cost(_ledger(spark, sf), _service_ledger(spark, sf)).withColumn("share", F.round("share", 9))


@query(f"""WITH {X.MODEL_CALLS}, {X.SERVICE_CALLS}, u AS (SELECT 'model' AS kind, task, cost FROM ledger UNION ALL SELECT 'service', task, cost FROM service_ledger)
           SELECT coalesce(kind, '<all>') AS kind, CASE WHEN grouping(task) = 1 THEN '<all>' ELSE task END AS task, coalesce(sum(cost), 0)::DOUBLE AS cost_usd, (grouping(kind) * 2 + grouping(task))::BIGINT AS level FROM u GROUP BY ROLLUP (kind, task)""")
def q_cost_rollup(spark, sf):
    return costs.cost_rollup(_ledger(spark, sf), _service_ledger(spark, sf))


PARADIGMS = f"""{BEST}, {X.JUDGEMENTS}, {VOTES.removeprefix('WITH ')},
    won AS (SELECT DISTINCT prompt, model, id, winner FROM judged WHERE winner IS NOT NULL),
    sure AS (SELECT prompt, model, id FROM answers WHERE coalesce(TRY_CAST(confidence AS DOUBLE), 0.0) >= 0.85 AND prompt NOT LIKE '%no-threshold'),
    right_ AS (SELECT w.prompt, w.model, w.id, coalesce(list_contains(s.best, winner), false)::INT AS ok FROM won w LEFT JOIN sets s USING (id)),
    consistency AS (
      SELECT 'judge' AS paradigm, model, sum(ok)::DOUBLE / count(*) AS score FROM right_ GROUP BY model
      UNION ALL SELECT 'human_loop', model, sum(ok)::DOUBLE / count(*) FROM right_ JOIN sure USING (prompt, model, id) GROUP BY model
      UNION ALL SELECT 'majority_voting', '(no LLM)', avg(CASE WHEN voters > 0 THEN round(best.n::DECIMAL(18,12) / voters, 4)::DOUBLE ELSE 0 END) FROM voters LEFT JOIN best USING (id))"""
LABEL_ACCURACY = f"""{PARADIGMS},\n{LLM_ROWS},\n{LLM_SUMMARY}, proxies AS (SELECT 'llmaas' AS paradigm, model, 1 - avg(human_wer) AS score FROM llm_summary GROUP BY model UNION ALL SELECT * FROM consistency)"""


def _paradigms(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    judged = _winners(spark, sf)
    looped = judged.withColumn("fallback_used", S.confidence(F.col("confidence")) < 0.85)
    return q_wer_rows(spark, sf), judged, looped, q_mode_vote(spark, sf)


@query(f"WITH {LABEL_ACCURACY} SELECT paradigm, model, round(score, 9) AS score FROM proxies")
def q_label_accuracy(spark, sf):
    """How good each paradigm's labels are: models alone, as judges, with a human in the loop, and the vote."""
    rows, judged, looped, voted = _paradigms(spark, sf)
    found = reports.label_accuracy(rows, _llm_summary(spark, sf), judged, looped, voted)
    return found.withColumn("score", F.round("score", 9))


@query(f"""WITH {LABEL_ACCURACY}, {X.MODEL_CALLS}, spent AS (SELECT CASE paradigm WHEN 'click' THEN 'llmaas' WHEN 'view' THEN 'judge' ELSE 'human_loop' END AS paradigm, model, sum(cost)::DOUBLE AS cost_usd FROM ledger WHERE cost >= 0 GROUP BY ALL)
           SELECT paradigm, model, round(score, 9) AS score, coalesce(cost_usd, 0) AS cost_usd FROM proxies LEFT JOIN spent USING (paradigm, model)""")
def q_pareto_join(spark, sf):
    """Accuracy and cost of each (paradigm, model); without any spending the cost is 0."""
    paradigm = F.when(F.col("paradigm") == "click", "llmaas").when(F.col("paradigm") == "view", "judge").otherwise("human_loop")
    spent = _ledger(spark, sf).filter("cost_usd >= 0").groupBy(paradigm.alias("paradigm"), "model").agg(costs.total("cost_usd").alias("cost_usd"))
    return q_label_accuracy(spark, sf).join(spent, ["paradigm", "model"], "left").withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))


@query(f"WITH {PARADIGMS} SELECT paradigm, model, round(score, 9) AS agreement FROM consistency")
def q_paradigm_consistency(spark, sf):
    found = reports.paradigm_consistency(*_paradigms(spark, sf))
    return found.select("paradigm", "model", F.round("score", 9).alias("agreement"))



# Passes, payloads, plans

@query(f"""WITH {X.ORACLE_ANSWERS} SELECT prompt, model, id, CASE WHEN id % 5 = 0 THEN 'old' WHEN id % 7 = 0 THEN 'n/a' ELSE answer END AS llm_oracle,
           CASE WHEN id % 5 = 0 THEN 'success' WHEN answer IS NULL OR id % 7 = 0 OR lower(trim(answer)) IN ('', 'n/a', 'na', 'null', 'none', 'nan') THEN 'failed' ELSE 'success' END AS status FROM oracle_answers""")
def q_oracle_pass(spark, sf):
    """One pass of the models' own answers: what is not there yet is answered from recorded replies in fenced JSON, and merged."""
    answers = X.oracle_answers(spark, sf)
    reply = F.when(F.col("id") % 7 == 0, "```json\n{}\n```").otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("answer").alias("transcript")), {"ignoreNullFields": "false"}), F.lit("\n```")))
    recorded = answers.select("prompt", "model", "id", reply.alias("content"))
    work = answers.select("prompt", "model", "id")
    done = work.filter("id % 5 = 0").withColumns({"llm_oracle": F.lit("old"), "status": F.lit("success")})
    return passes.oracle_pass(work, done, lambda w: w.join(recorded, ["prompt", "model", "id"]), "asr").withColumn("id", F.col("id").cast("long"))


@query(f"""WITH {X.JUDGEMENTS}, u AS (SELECT prompt, model, id, bool_or(score >= 0) AND any_value(winner) IS NOT NULL AS usable FROM judged GROUP BY prompt, model, id)
           SELECT prompt, model, id, llm_label, winner, confidence, service, score, is_winner, coalesce(usable, false) AS usable FROM judged JOIN u USING (prompt, model, id)""")
def q_judge_pass(spark, sf):
    """One pass of judges: prompts are made of the panel's outputs, recorded replies in JSON are parsed and spread over the services."""
    a = X.judgements(spark, sf)
    reply = F.to_json(F.struct(F.col("llm_label").alias("llm_transcript"), "winner", "scores", "confidence"))
    asked = passes.judge_prompts(X.text_panel(spark, sf), "Which of these is best?\n{service_blocks}")
    recorded = a.select("prompt", "model", "id", reply.alias("content"))
    done = judging.judge_rows(a.limit(0).withColumn("usable", F.lit(True)), X.SERVICES)
    rows = passes.judge_pass(a.select("prompt", "model", "id"), done, lambda w: w.join(asked, "id").filter("asked is not null").join(recorded, ["prompt", "model", "id"]), X.SERVICES)
    return rows.select("prompt", "model", F.col("id").cast("long").alias("id"), "llm_label", "winner", "confidence", "service", "score", "is_winner", "usable")


@query(f"""WITH {X.TEXT_PANEL} SELECT id, 'Judge these:' || chr(10) || string_agg(service || ': ' || service_output, chr(10) ORDER BY svc_ord) AS asked FROM text_panel GROUP BY id""")
def q_judge_prompt(spark, sf):
    return passes.judge_prompts(X.text_panel(spark, sf), "Judge these:\n{service_blocks}")


STORED = """stored AS (SELECT vec_id AS id, 'svc_' || k AS service, k AS svc_ord, ((vec_id * 31 + k * 17 + v * 7) % 101) / 100.0::DOUBLE AS score, v FROM embeddings, range(6) t(k), range(2) r(v) WHERE (v = 0 OR k = 2) AND (vec_id + k) % 5 <> 0)"""


@query(f"""WITH {STORED}, last AS (SELECT id, service, svc_ord, score FROM (SELECT *, row_number() OVER (PARTITION BY id, service ORDER BY v DESC) AS n FROM stored) WHERE n = 1)
           SELECT id, first(service ORDER BY score DESC, svc_ord) AS best_service FROM last GROUP BY id""")
def q_winner_by_score(spark, sf):
    """The human loop's winner in translation: the highest stored score; of several rows of a service the last counts."""
    e = X.each(X.each(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), "svc_ord", 6), "v", 2).filter("(v = 0 or svc_ord = 2) and (id + svc_ord) % 5 <> 0")
    rows = e.select("id", F.concat(F.lit("svc_"), "svc_ord").alias("service"), "svc_ord", "v", (((F.col("id") * 31 + F.col("svc_ord") * 17 + F.col("v") * 7) % 101) / 100.0).alias("score"))
    return judging.best_service(passes.last_scores(rows, "score", "v"), "score", True, "id")


@query(f"WITH {X.LABEL_PANEL} SELECT id, first(service ORDER BY svc_ord) AS best_service FROM label_panel WHERE reference <> '' AND label = reference GROUP BY id")
def q_winner_by_match(spark, sf):
    """The human loop's winner in emotions: the first service that says the human label."""
    return passes.first_match(X.label_panel(spark, sf))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id % 900 WHEN 1 THEN event_id % 800 WHEN 2 THEN event_id % 700 END AS input_tokens,
          CASE event_id % 4 WHEN 0 THEN event_id % 90 WHEN 1 THEN event_id % 80 WHEN 2 THEN event_id % 70 END AS output_tokens, CASE event_id % 4 WHEN 0 THEN 2 * (event_id % 50) WHEN 2 THEN event_id % 40 END AS audio_input_tokens FROM events""")
def q_usage(spark, sf):
    """Token counts of usage objects of several shapes."""
    n = F.col("event_id")
    first = F.format_string('{"prompt_token_count":%d,"candidates_token_count":"%d","prompt_tokens_details":[{"modality":"AUDIO","token_count":%d},{"modality":"TEXT","token_count":9},{"modality":"audio","token_count":%d}]}', n % 900, n % 90, n % 50, n % 50)
    second = F.format_string('{"prompt_token_count":"many","input_tokens":%d,"completion_tokens":%d,"prompt_tokens_details":[{"modality":"TEXT","token_count":3}]}', n % 800, n % 80)
    third = F.format_string('{"prompt_tokens":%d,"output_tokens":%d,"input_tokens_details":{"audio_tokens":%d}}', n % 700, n % 70, n % 40)
    usage = F.when(n % 4 == 0, first).when(n % 4 == 1, second).when(n % 4 == 2, third)
    return table(spark, sf, "events").select("event_id", P.usage_counts(usage).alias("u")).select("event_id", "u.*")


ERROR_TEXTS = [(503, "busy", "retryable"), (None, "Rate limit reached", "retryable"), (401, "no", "fatal"), (None, "API key not valid", "fatal"), (404, "gone, temporarily", "retryable"), (400, "bad input", "other"), (None, None, "other"), (403, "", "fatal")]


@query(f"SELECT event_id, ({[k for _, _, k in ERROR_TEXTS]})[(event_id % {len(ERROR_TEXTS)}) + 1] AS kind FROM events")
def q_error_kind(spark, sf):
    """Errors that another try can mend, that end a model's run, or that concern one sample only."""
    at = (F.col("event_id") % len(ERROR_TEXTS)).cast("int")
    code, text = (F.get(F.array(*[F.lit(x[i]).cast(kind) for x in ERROR_TEXTS]), at) for i, kind in ((0, "int"), (1, "string")))
    return table(spark, sf, "events").select("event_id", P.error_kind(code, text).alias("kind"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'sad' WHEN label % 2 = 0 THEN 'happy' ELSE 'sad' END AS name, CASE WHEN vec_id % 3 = 0 THEN 0.25 WHEN label % 2 = 0 THEN 0.75 ELSE 0.25 END::DOUBLE AS score, vec_id % 5 = 0 AS contempt,
          '{"emotions":{"happy":' || CASE WHEN vec_id % 3 = 0 THEN 'null' WHEN label % 2 = 0 THEN '0.75' ELSE '0.125' END || ',"sad":0.25},"top_emotion":{"name":"' || CASE WHEN vec_id % 3 <> 0 AND label % 2 = 0 THEN 'happy","score":0.75' ELSE 'sad","score":0.25' END || '}}' AS payload FROM embeddings""")
def q_emotion_payload(spark, sf):
    """Top emotion, contempt and the payload of score maps."""
    happy = F.when(F.col("vec_id") % 3 != 0, F.when(F.col("label") % 2 == 0, 0.75).otherwise(0.125))
    scores = F.create_map(F.lit("happy"), happy, F.lit("sad"), F.lit(0.25))
    raw = F.map_concat(scores, F.create_map(F.lit("Contempt"), F.when(F.col("vec_id") % 5 == 0, 0.1)))
    e = table(spark, sf, "embeddings").select("vec_id", P.top_emotion(scores).alias("top"), P.contempt_reported(raw).alias("contempt"), P.emotion_payload(scores).alias("payload"))
    return e.select("vec_id", "top.name", "top.score", "contempt", "payload")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'happy' WHEN 1 THEN 'sad' WHEN 2 THEN 'fear' WHEN 3 THEN 'plain words' ELSE '' END AS for_vote, CASE event_id % 5 WHEN 0 THEN 'happy' WHEN 3 THEN '' ELSE '' END AS for_judge FROM events""")
def q_top_label(spark, sf):
    """Labels of payloads, with and without the other fields and the raw text as a last resort."""
    n = F.col("event_id")
    said = F.when(n % 5 == 0, '{"top_emotion":{"name":" Happy "}}').when(n % 5 == 1, '{"label_name":"SAD"}').when(n % 5 == 2, '{"label":"Fear"}').when(n % 5 == 3, "Plain words").otherwise("{}")
    judge = T.top_label(said, fallback="empty", other_keys=())
    return table(spark, sf, "events").select("event_id", OUTPUT_KINDS["emotion"].label(said).alias("for_vote"), judge.alias("for_judge"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id / 60.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS minutes FROM events")
def q_audio_minutes(spark, sf):
    n = F.col("event_id")
    duration = F.when(n % 4 == 0, n.cast("string")).when(n % 4 == 1, "30").when(n % 4 == 2, "NaN").otherwise("long")
    return table(spark, sf, "events").select("event_id", P.audio_minutes(duration).alias("minutes"))



# Keyed tables and progress

UPSERT = """old AS (SELECT event_id AS id, event_type AS prompt, value, 'old' AS origin FROM events WHERE event_id % 3 <> 0),
    new AS (SELECT event_id AS id, event_type AS prompt, value + 1 AS value, 'new' AS origin FROM events WHERE event_id % 5 = 0)"""


def _old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select(F.format_string("%04d", F.col("event_id")).alias("id"), F.col("event_type").alias("prompt"), "value", "event_id")
    old = e.filter("event_id % 3 <> 0").withColumn("origin", F.lit("old"))
    new = e.filter("event_id % 5 = 0").withColumns({"origin": F.lit("new"), "value": F.col("value") + 1, "id": F.col("event_id").cast("string")})
    return old.drop("event_id"), new.drop("event_id")


@query(f"WITH {UPSERT} SELECT id, prompt, value, origin FROM new UNION ALL SELECT id, prompt, value, origin FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.id = old.id AND new.prompt = old.prompt)")
def q_upsert(spark, sf):
    old, new = _old_new(spark, sf)
    return store.upsert(old, new, ["prompt", "id"]).withColumn("id", F.col("id").cast("long"))


@query(f"WITH {UPSERT} SELECT id, prompt, value, origin FROM old WHERE prompt <> 'click' UNION ALL SELECT id, prompt, value, origin FROM new WHERE prompt = 'click'")
def q_slice_replace(spark, sf):
    old, new = _old_new(spark, sf)
    return store.replace_slice(old, new, "prompt", "click").withColumn("id", F.col("id").cast("long"))


@query(f"WITH {UPSERT} SELECT id, prompt FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.id = old.id AND new.prompt = old.prompt)")
def q_pending(spark, sf):
    old, new = _old_new(spark, sf)
    return store.pending(old.select("id", "prompt"), new, ["prompt", "id"]).withColumn("id", F.col("id").cast("long"))


SLICES = "slices AS (SELECT event_type AS prompt, user_id % 3 AS model, count(*) FILTER (WHERE event_id % 4 <> 0 OR user_id % 3 = 0) AS done, count(*) AS total FROM events GROUP BY ALL)"


@query(f"WITH {SLICES} SELECT *, done = total AS complete FROM slices")
def q_slice_complete(spark, sf):
    planned = table(spark, sf, "events").select(F.col("event_type").alias("prompt"), (F.col("user_id") % 3).alias("model"), F.col("event_id").alias("id"))
    return store.slice_status(planned, planned.filter("id % 4 <> 0 or model = 0"), ["prompt", "model", "id"], ["prompt", "model"])


@query(f"WITH {SLICES} SELECT sum(done)::BIGINT AS done, sum(total)::BIGINT AS total, count(*) FILTER (WHERE done > 0) AS started, count(*) FILTER (WHERE done >= total) AS complete, round((100 * sum(done))::DECIMAL(28,12) / sum(total), 1)::DOUBLE AS percent, 'incomplete' AS status FROM slices")
def q_progress(spark, sf):
    return store.progress(q_slice_complete(spark, sf))


MODEL_ENTRIES = {"m0": {"enabled": True, "provider": "x"}, "m1": {"provider": "y"}, "m2": {"enabled": True}, "m3": {"enabled": "yes"}, "m4": None}
PROMPTS = [("task0", "oracle_long", 0), ("task0", "Judge_medium", 1), ("task1", "oracle_short", 0), ("task1", "oracle_long", 1), ("task1", "judge_long", 2)]


@query("SELECT 'task' || (doc_id % 2) AS task, count(*) * 2 * CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS jobs FROM documents GROUP BY doc_id % 2")
def q_plan(spark, sf):
    """Planned jobs: samples x enabled models x prompts of each task."""
    samples = table(spark, sf, "documents").select(F.concat(F.lit("task"), F.col("doc_id") % 2).alias("task"))
    return config.planned_jobs(samples, config.entries(spark, MODEL_ENTRIES), spark.createDataFrame(PROMPTS, "task string, prompt string, ord int"))


@query("""SELECT * FROM (VALUES ('task0', 'Judge_medium'), ('task1', 'oracle_short')) p(task, prompt)
          JOIN (SELECT CASE WHEN event_id % 2 = 0 THEN 'task0' ELSE 'task1' END AS task, first('m' || (user_id % 4) ORDER BY user_id % 4) AS model FROM events WHERE event_id % 11 <> 0 AND user_id % 4 <> 0 GROUP BY 1) USING (task)""")
def q_preferred(spark, sf):
    """The prompt and the model that a smoke test of each task starts from."""
    e, m = table(spark, sf, "events"), (F.col("user_id") % 4).cast("int")
    cells = e.select(F.when(F.col("event_id") % 2 == 0, "task0").otherwise("task1").alias("task"), F.concat(F.lit("m"), m).alias("model"), m.alias("ord"), F.when((F.col("event_id") % 11 != 0) & (m != 0), "success").otherwise("failed").alias("status"))
    return config.preferred(spark.createDataFrame(PROMPTS, "task string, prompt string, ord int")).join(config.first_working(cells), "task")


@query("""WITH a AS (SELECT conv_id AS id, turn AS attempt, (conv_id + turn) % 3 = 0 AS ok, length(text) AS cost, role FROM conversations)
          SELECT id, first(attempt ORDER BY ok DESC, CASE WHEN ok THEN attempt ELSE -attempt END) AS attempt, CASE WHEN bool_or(ok) THEN 'success' ELSE 'failed' END AS status, count(*) AS attempts, round(sum(cost::DECIMAL(28,6) / 1000), 6)::DOUBLE AS cost_usd FROM a GROUP BY id""")
def q_retry_resolve(spark, sf):
    a = table(spark, sf, "conversations").select(
        F.lit("asr").alias("task"), F.lit("m0").alias("model"), F.col("conv_id").alias("id"), F.col("turn").alias("attempt"), ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("ok"), F.col("role").alias("content"), (F.char_length("text") / 1000).alias("cost_usd")
    )
    return costs.settled_attempts(a).select("id", "attempt", "status", "attempts", "cost_usd")


@query(f"""WITH {LLM_ROWS} SELECT prompt, model, 'llmaas' AS service, sum(human_errors)::BIGINT AS errors, sum(human_ref_words)::BIGINT AS ref_words, count(*) AS n_samples, sum(human_errors)::DOUBLE / nullif(sum(human_ref_words), 0) AS wer FROM llm_errors GROUP BY prompt, model""")
def q_llmaas_backfill(spark, sf):
    """Stored model answers scored as if they came from one more service, all prompts and models in one pass."""
    return metrics.word_error_rate(_llm_rows(spark, sf), "prompt", "model", "service")


@query()
def q_wer_full(spark, sf):
    """Word error rates of whole documents, however long: each against itself with every seventh word changed and every eleventh missing. Beyond SQL's one-byte letters; tested against plain Python."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("human")), "id").withColumn("w", T.tokens(F.col("human")))
    changed = F.filter(F.transform("w", lambda w, n: F.when((n + F.col("id")) % 7 == 0, F.concat(F.lit("x"), n.cast("string"))).otherwise(w)), lambda w, n: (n + F.col("id")) % 11 != 0)
    return metrics.word_error_rows(d.select("id", "lang", "human", F.lit("echo").alias("service"), F.array_join(changed, " ").alias("service_output")), long=True)


@query("""SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS id FROM (SELECT doc_id, (doc_id * 7919 + 42) % 10007 AS h FROM documents WHERE n_chars / 15.0 BETWEEN 20 AND 100) ORDER BY h, doc_id LIMIT 100""")
def q_sample_scan(spark, sf):
    """A seeded sample of texts of some length, with dense new ids."""
    from quorumlens.sources.samples import seeded_sample

    docs = table(spark, sf, "documents").filter((F.col("n_chars") / 15.0).between(20, 100))
    order = (F.col("doc_id") * 7919 + 42) % 10007
    return seeded_sample(docs.select("doc_id"), 100, "doc_id", order=order).select("doc_id", "id")


@query("SELECT model, count(*) FILTER (WHERE status = 'success') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status IS NULL) AS skipped FROM (" + f"WITH {X.MODEL_CALLS} SELECT * FROM calls" + ") GROUP BY model")
def q_smoke_matrix(spark, sf):
    return X.model_calls(spark, sf).groupBy("model").agg(
        F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull()).alias("skipped")
    )


@query(f"""WITH {X.MODEL_CALLS}, w AS (SELECT paradigm AS prompt, model, min(CASE WHEN status = 'failed' THEN 0 WHEN status IS NULL THEN 1 ELSE 2 END) AS worst FROM calls GROUP BY ALL)
           SELECT prompt, """ + ", ".join(f"(['failed', 'skipped', 'ok'])[max(worst) FILTER (WHERE model = 'm{k}') + 1] AS m{k}" for k in range(4)) + " FROM w GROUP BY prompt")
def q_smoke_cells(spark, sf):
    calls = X.model_calls(spark, sf).select(F.col("paradigm").alias("prompt"), "model", "status")
    return reports.smoke_matrix(calls, [f"m{k}" for k in range(4)])
