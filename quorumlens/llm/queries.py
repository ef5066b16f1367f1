"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm import bpe
from quorumlens.llm.chat_format import format_chats, read_back
from quorumlens.llm.chat_repair import digests, repair_conversations
from quorumlens.llm.common import scratch_path
from quorumlens.llm.decontaminate import find_contamination
from quorumlens.llm.exact_dedup import duplicate_report
from quorumlens.llm.pii import find_pii, sanitise, span_list
from quorumlens.llm.quality import fit_quality, quality_score
from quorumlens.llm.resample import resample
from quorumlens.llm.set_join import jaccard_components
from quorumlens.llm.simhash import hamming_components
from quorumlens.llm.token_shards import read_documents, with_starts, write_shards
from quorumlens.llm.toxicity import fit_toxicity, toxicity_score
from quorumlens.llm.url_filter import judge_urls
from quorumlens.session import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def id_remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").filter(id_remainder(5) != 0).select("doc_id", "quality")
    machine = fit_quality(sampled(docs, labels, 6000), max_train=6000)
    scored = docs.select("doc_id", (id_remainder(5) == 0).alias("held_out"), quality_score(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The documents of at most ``most`` labels, those with the smallest hash of their id."""
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(some), "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = id_remainder(4) != 2
    model = fit_toxicity(docs.filter(learn), table(spark, sf_dir, "labels").filter(learn).select("doc_id", "toxic"))
    scored = docs.select("doc_id", (~learn).alias("held_out"), toxicity_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), target)
    shards = spark.read.parquet(target)
    read = read_documents(shards).select("part", "shard", "offset", "doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return with_starts(read, shards).select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = hamming_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=2)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), whole=True)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    both = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text"), path).alias("both")).select("doc_id", "both.*")
    return both.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = span_list(F.filter("pii_spans", lambda x: x["kind"] != "term"))
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("pii_spans")).alias("spans"),
                        F.sha2(sanitise(F.col("text"), F.col("pii_spans")).cast("binary"), 256).alias("sanitised_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = duplicate_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    target = scratch_path(spark, "formatted-chats")
    format_chats(turns).write.parquet(target)
    formatted = spark.read.parquet(target)
    lengths = formatted.select(F.col("conv_id").alias("_conv_id"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    back = read_back(formatted)
    back = back.join(lengths, F.col("conv_id").eqNullSafe(F.col("_conv_id")))  # turns without conv_id are a conversation too
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"), percent=25, min_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with one damage in four, chosen by crc32 of ``conv_id:turn``; nulls become one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = turns.withColumn("hit", hit).filter("hit <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    reports, after = repair_conversations(damaged(turns))
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    all_ids = turns.select("conv_id").distinct().alias("i")
    joined = all_ids.join(reports.alias("r"), same("i", "r"), "left").join(digests(after).alias("d"), same("i", "d"), "left")
    numbers = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("i.conv_id", *numbers, F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_token_shards": op5_token_shards,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_resample": op11_resample,
    "op12_chat_repair": op12_chat_repair,
    "op13_set_join": op13_set_join,
}

#: The unsigned crc32 of a text ``x``, bit by bit over its UTF-8 bytes.
CRC32 = """xor(4294967295, list_reduce(
             list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({x}))::BIGINT), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::BIGINT)),
             lambda c, byte: list_reduce([xor(c, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, (v & 1) * 3988292384))))"""

#: op3 and op6 decide by corpus statistics in floating point; their rules, hosts and base spans are tested against brute force.
ORACLE_SQL = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op10_chat_format": r"""
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
          SELECT *, length(regexp_replace(text, '(</?|\[/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g')) AS n,
                 role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS fresh
          FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(n + CASE WHEN fresh THEN length(role) + 17 ELSE 3 END)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op11_resample": r"""
        WITH rows AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, 0 AS t
          FROM documents
          UNION ALL
          SELECT NULL, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1
          FROM benchmark),
        features AS (SELECT r, t, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM rows),
        counted AS (SELECT r, t, f, count(*) AS n FROM features GROUP BY ALL),
        hashed AS (SELECT f, """ + CRC32.format(x="f") + r""" % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted)),
        placed AS (SELECT r, t, bucket, n FROM counted JOIN hashed USING (f)),
        gains AS (
          SELECT bucket, floor(1000 * ln((sum(n * t) + 1)::DOUBLE * (sum(sum(n * (1 - t))) OVER () + 10000)::DOUBLE
                                         / ((sum(n * (1 - t)) + 1)::DOUBLE * (sum(sum(n * t)) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
          FROM placed GROUP BY bucket),
        weights AS (SELECT r, floor(sum(n * gain) / sum(n)) AS weight FROM placed JOIN gains USING (bucket) WHERE t = 0 GROUP BY r),
        scored AS (
          SELECT doc_id, len(w) AS n_words, greatest(2 * len(w) - 1, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                 coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM rows LEFT JOIN weights USING (r) WHERE t = 0),
        placed_rows AS (
          SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, 25 * count(*) FILTER (WHERE n_words >= 20) OVER () // 100 AS drawn FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed_rows""",
    # the same edits by dynamic programming: the best (cost, audit) of each state of the pattern after each row, as texts that sort by cost and then audit
    "op12_chat_repair": r"""
        WITH RECURSIVE hits AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 """ + CRC32.format(x="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))") + r""" % 20 AS hit
          FROM conversations),
        damaged AS (
          SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(range(CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy
          FROM hits WHERE hit <> 0),
        numbered AS (
          SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS visible,
                 CASE role WHEN '' THEN '_' ELSE left(role, 1) END AS initial
          FROM damaged),
        faults AS (
          SELECT *, CASE WHEN visible = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(visible, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
                 coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
          FROM numbered),
        found AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                 count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, list(initial ORDER BY pos) AS initials, list(fault ORDER BY pos) AS faults
          FROM faults GROUP BY conv_id),
        -- best: one text for each state (nothing, after s, after u, after a): cost in eight digits, then the audit; a state that is out of reach has a cost of 99999999
        open_states AS (
          SELECT conv_id, initials, faults, 0 AS i, ['00000000', '99999999', '00000005I', '00000010II'] AS best FROM found
          UNION ALL
          SELECT conv_id, initials, faults, i + 1, [none, s, u, least(a, lpad((left(u, 8)::INT + 5)::VARCHAR, 8, '0') || substr(u, 9) || 'I')]
          FROM (
            SELECT conv_id, initials, faults, i, none, s, a,
                   least(u, lpad((left(none, 8)::INT + 5)::VARCHAR, 8, '0') || substr(none, 9) || 'I', lpad(least(left(s, 8)::INT + 5, 99999999)::VARCHAR, 8, '0') || substr(s, 9) || 'I',
                         lpad((left(a, 8)::INT + 5)::VARCHAR, 8, '0') || substr(a, 9) || 'I') AS u
            FROM (
              SELECT conv_id, initials, faults, i, d[1] AS none,
                     least(d[2], CASE WHEN stays AND initial = 's' THEN k[1] END) AS s,
                     least(d[3], CASE WHEN stays THEN least(r[1], r[2], r[4]) END, CASE WHEN stays AND initial = 'u' THEN least(k[1], k[2], k[4]) END) AS u,
                     least(d[4], CASE WHEN stays THEN r[3] END, CASE WHEN stays AND initial = 'a' THEN k[3] END) AS a
              FROM (
                SELECT conv_id, initials, faults, i, initials[i + 1] AS initial, faults[i + 1] IN ('t', '.') AS stays, CASE faults[i + 1] WHEN 't' THEN 5 ELSE 0 END AS charge,
                       list_transform(best, lambda b: lpad(least(left(b, 8)::INT + 2, 99999999)::VARCHAR, 8, '0') || substr(b, 9) || 'D') AS d,
                       list_transform(best, lambda b: lpad(least(left(b, 8)::INT + charge, 99999999)::VARCHAR, 8, '0') || substr(b, 9) || 'K') AS k,
                       list_transform(best, lambda b: lpad(least(left(b, 8)::INT + 1 + charge, 99999999)::VARCHAR, 8, '0') || substr(b, 9) || 'R') AS r
                FROM open_states WHERE i < len(initials)) AS steps) AS moved) AS put),
        chosen AS (SELECT conv_id, left(least(best[1], best[4]), 8)::BIGINT AS cost, substr(least(best[1], best[4]), 9) AS audit, initials FROM open_states WHERE i = len(initials)),
        edits AS (SELECT conv_id, initials, unnest(range(1, length(audit) + 1)) AS k, audit FROM chosen),
        placed AS (
          SELECT conv_id, k, audit[k] AS edit, initials, k - length(replace(left(audit, k), 'I', '')) AS skipped,
                 row_number() OVER (PARTITION BY conv_id ORDER BY k) AS place
          FROM edits WHERE audit[k] <> 'D'),
        turns_after AS (
          SELECT placed.conv_id, place, role, text, edit, coalesce(first_value(edit = 'K' AND initial = 's') OVER (PARTITION BY placed.conv_id ORDER BY place), false)::INT AS system
          FROM placed LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM placed.conv_id AND pos = k - skipped AND edit <> 'I'),
        hashed AS (
          SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS repaired_sha256
          FROM turns_after GROUP BY conv_id)
        SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS ids LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM ids.conv_id
        LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM ids.conv_id""",
}
