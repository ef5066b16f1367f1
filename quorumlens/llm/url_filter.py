"""URL filter: allow and block rules, and a character language-model ratio where no rule fits.

Urls that a rule allows train one model, urls that a rule blocks another: variable-order Markov models of the
whole url (scheme, host, path, query and fragment; letters A-Z lower-cased, every digit as 0, all else as it is), with contexts of
four characters down to none, interpolated by Witten-Bell smoothing (a context that was never seen is
skipped). A url's score is the difference of its two log likelihoods divided by its length. The threshold is calibrated on a fifth of the
ruled urls, which the models do not see: it is the point half way between the two classes' mean scores there. Counts cover
all urls.

The table of counts grows with the corpus: it is a DataFrame and joined, and sent to every executor only while it is small. A gram, host or url
that fills the table is spread over salts where it is joined. Log likelihoods are summed as whole millionths, so sums don't depend on order.

Defined results: a null url or one without ``://`` has an empty host and path; a null url is scored as the empty
text; without any allowed or any blocked url to learn from, urls without a rule are allowed. Rows that repeat are each judged. New columns are named
host, path, rule, verdict and score, with a leading underscore each where the table has the name already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import FEW, cut, free_name, salted_join, spread

#: Host, path and verdict of each rule.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of context of the longest model; marks of a url's start and end; the probability of a character before anything is known.
ORDER, START, END, UNKNOWN = 4, "\x02", "\x03", 1.0 / 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tried first
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def ngrams(text: Column, order: int = ORDER) -> Column:
    """Every character of a url (and its end) with the ``order`` characters before it."""
    marked = F.concat(F.lit(START * order), F.regexp_replace(F.translate(text, UPPER, LOWER), "[0-9]", "0"), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(marked) - order), lambda i: F.substring(marked, i, F.lit(order + 1)))


def gram_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """For each gram: the log of its last character's probability if allowed minus that if blocked, in millionths. grams: gram, n_allow, n_block, written already.

    The models go from no context to the longest; each level is counted from ``grams``, looks up its contexts' sums and the level before, and is written.
    A level has each of its grams once, so a context meets no more rows than there are characters.
    """
    both = ("allow", "block")
    shorter = None
    for k in range(order + 1):  # characters of context
        level = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("part")).agg(*[F.sum(f"n_{x}").alias(f"n_{x}") for x in both])
        level = level.withColumns({"context": F.substring("part", 1, k), "rest": F.right("part", F.lit(k))})
        sums = level.groupBy("context").agg(*[F.sum(f"n_{x}").alias(f"sum_{x}") for x in both], *[F.count_if(F.col(f"n_{x}") > 0).alias(f"kinds_{x}") for x in both])
        level = level.join(sums, "context")
        if shorter is not None:
            level = level.join(shorter.withColumnRenamed("part", "rest"), "rest")
        p = {}
        for x in both:
            n, total, kinds = (F.col(f"{c}_{x}") for c in ("n", "sum", "kinds"))
            before = F.col(f"p_{x}") if shorter is not None else F.lit(UNKNOWN)
            p[x] = F.when(total > 0, (n + kinds * before) / (total + kinds)).otherwise(before)
        shorter = cut(level.select("part", *[p[x].alias(f"p_{x}") for x in both]))
    ratio = F.round((F.log("p_allow") - F.log("p_block")) * 1e6).cast("long")
    return shorter.select(F.col("part").alias("gram"), ratio.alias("ratio"))


def text_scores(texts: DataFrame) -> DataFrame:
    """scored, rule_verdict, n and score of the ``texts`` (scored, rule_verdict, part, n) that do not train."""
    grams = texts.select("rule_verdict", "part", "n", F.explode_outer(ngrams(F.col("scored"))).alias("gram"))
    trained = lambda x: F.sum(F.when((F.col("part") == "train") & (F.col("rule_verdict") == x), F.col("n")).otherwise(0)).alias(f"n_{x}")
    grams = cut(grams.groupBy("gram").agg(trained("allow"), trained("block"), F.count_if(F.col("part") != "train").alias("uses")))
    ratios = cut(gram_ratios(grams).join(grams.select("gram", "uses"), "gram").filter("uses > 0"))
    places = texts.filter("part <> 'train'").select("scored", "rule_verdict", "n", F.explode_outer(ngrams(F.col("scored"))).alias("gram"))
    few = ratios.limit(FEW + 1).count() <= FEW
    found = places.join(F.broadcast(ratios), "gram") if few else salted_join(places, ratios, ["gram"], "uses", "scored")
    return found.groupBy("scored", "rule_verdict", "n").agg((F.sum("ratio") / F.count(F.lit(1)) / 1e6).alias("score"))


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rows of ``pages`` with host, path, rule, verdict and score (null where a rule decides)."""
    host_, path_, rule_, verdict_, score_ = names = [free_name(pages, x) for x in ("host", "path", "rule", "verdict", "score")]
    scored, n, apart = (free_name(pages, x) for x in ("scored", "n", "apart"))
    host, path = host_and_path(F.col(url))
    parts = pages.withColumns({host_: host, path_: path})
    rule, verdict = fitting_rule(F.col(host_), F.col(path_), rules)
    ruled = parts.withColumns({rule_: rule, verdict_: verdict, scored: F.coalesce(F.col(url), F.lit(""))})
    # one row for each different url, with its number of rows: a url that fills the table counts as many, and is scored once
    texts = ruled.groupBy(F.col(scored).alias("scored"), F.col(verdict_).alias("rule_verdict")).agg(F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("rule_verdict").isNull(), "score").when(F.pmod(F.xxhash64("scored"), F.lit(5)) == 0, "calibrate").otherwise("train")
    scores = cut(text_scores(cut(spread(texts.withColumn("part", part), "scored"))))
    held_out = scores.filter("rule_verdict is not null").groupBy("rule_verdict").agg((F.sum(F.round(F.col("score") * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6).alias("mean"))
    means = dict(held_out.collect())  # two rows
    threshold = sum(means.values()) / 2 if len(means) == 2 else None
    by_model = F.when(F.col(score_) >= threshold, "allow").otherwise("block") if threshold is not None else F.lit("allow")
    table = scores.filter("rule_verdict is null").select(F.col("scored").alias(scored), F.col("n").alias(n), F.col("score").alias(score_))
    known = [f.name for f in pages.schema if f.name != url and "map<" not in f.dataType.simpleString()]
    open_ = ruled.filter(F.col(rule_).isNull()).withColumn(apart, F.xxhash64(*known) if known else F.lit(0))
    judged = salted_join(open_, table, [scored], n, apart).withColumn(verdict_, by_model)
    columns = [*pages.columns, *names]
    return ruled.filter(F.col(rule_).isNotNull()).withColumn(score_, F.lit(None).cast("double")).select(*columns).unionByName(judged.select(*columns))
