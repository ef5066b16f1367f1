"""Personal data: fixed patterns, and information-theoretic sanitisation of what else gives it away.

Base spans come from four patterns with checks (email, ip, card, phone). The method then asks of every
word that stands near such a span how strongly it reveals the protected entities behind it: the value itself in its normal form,
and who or what holds it (an email's name and domain, an address's network, a card's issuer, a phone's area). From the
whole corpus it counts how often a word occurs at all and how often it occurs within ``reach`` words of
an entity's spans (and not beyond the next match of the same kind). A word discloses an entity if

* it stands near it in at least ``min_contexts`` different contexts (copies of a context count once),
* the share of its occurrences that are near the entity, P(entity | word), is ``min_share`` or more, and
* that is at least ``min_bits`` bits of information: log2 P(entity | word) / P(entity).

Disclosing words are spans of kind ``term`` wherever they occur; `sanitise` replaces base spans by their
kind (generalised) and terms by nothing (removed). Everything is DataFrame and SQL functions.

Defined results: null text is empty; candidates that fail a check are dropped without another try; spans
are in code points with an exclusive end. Rows that repeat are each reported; all other columns, whatever their names, stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlens.llm.common import cut, free_name, running_starts, salted_join, text_of

KINDS = ("email", "ip", "card", "phone", "term")
#: The fixed patterns, in possessive form: a run is tried from its start only, so long runs take linear time.
#: Java finds the same leftmost matches with them as with [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[\p{L}\p{N}]{3,}"
NOT_WORD = r"[^\p{L}\p{N}]+"


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i counts from the right
    twice = lambda i: F.when(value(i) * 2 > 9, value(i) * 2 - 9).otherwise(value(i) * 2)
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 1, twice(i)).otherwise(value(i)))
    return F.aggregate(places, F.lit(0), lambda a, b: a + b) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.coalesce(F.regexp_replace(part, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _checked(kind: str, items: Column, starts: Column, contexts: bool, reach: int) -> Column:
    """The items of a kind as spans, without those that fail its check."""

    def words(gap: Column) -> Column:
        return F.transform(F.regexp_extract_all(gap, F.lit(WORD), F.lit(0)), F.lower)

    def span(x: Column, s: Column) -> Column:
        fields = [F.lit(kind).alias("kind"), (s + x["gap"]).alias("start"), (s + x["gap"] + x["length"]).alias("end"), x["value"].alias("value")]
        if contexts:
            fields.append(F.concat(F.slice(F.reverse(words(x["before"])), 1, reach), F.slice(words(x["after"]), 1, reach)).alias("near"))
        return F.struct(*fields)

    return F.filter(F.zip_with(items, starts, span), lambda x: is_valid(kind, x["value"]))


def base_spans(docs: DataFrame, text: str = "text", spans: str = "spans", contexts: bool = False, reach: int = 8) -> DataFrame:
    """``docs`` with an array of struct<kind, start, end, value>; with ``contexts``, also the words near each span."""
    names = {k: tuple(free_name(docs, f"{k}_{x}") for x in ("matches", "gaps", "items", "starts")) for k in PATTERNS}
    nothing = F.array().cast("array<string>")
    likely = {"email": F.contains(text_of(text), F.lit("@")), "phone": F.contains(text_of(text), F.lit("+"))}
    digit = text_of(text).rlike("[0-9]")
    found, items, starts = {}, {}, {}
    for kind, (matches, gaps, item, start) in names.items():
        pattern, may = F.lit(PATTERNS[kind]), likely.get(kind, digit)
        found[matches] = F.when(may, F.regexp_extract_all(text_of(text), pattern, F.lit(0))).otherwise(nothing)
        found[gaps] = F.when(may, F.split(text_of(text), PATTERNS[kind], -1)).otherwise(nothing)
        pair = F.arrays_zip(F.col(matches).alias("value"), F.slice(F.col(gaps), 1, F.size(matches)).alias("gap"), F.slice(F.col(gaps), 2, F.size(matches)).alias("next"))
        items[item] = F.transform(pair, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["value"]).alias("length"), x["value"].alias("value"), x["gap"].alias("before"), x["next"].alias("after")))
        starts[start] = running_starts(F.transform(F.col(item), lambda x: x["gap"] + x["length"]))
    placed = docs.withColumns(found).withColumns(items).withColumns(starts)
    parts = [_checked(kind, F.col(item), F.col(start), contexts, reach) for kind, (_, _, item, start) in names.items()]
    return placed.withColumn(spans, F.concat(*parts)).drop(*[x for n in names.values() for x in n])


def entities(kind: Column, value: Column) -> Column:
    """array<struct<level, name>>: what a span protects, from the value itself to who or what holds it."""
    low, digits = F.lower(value), F.regexp_replace(value, "[^0-9]", "")
    of = lambda **names: F.array(*[F.struct(F.lit(level).alias("level"), name.alias("name")) for level, name in names.items()])
    found = (
        F.when(kind == "email", of(value=low, holder=F.regexp_replace(F.substring_index(low, "@", 1), "[^a-z]+", ""), domain=F.substring_index(low, "@", -1)))
        .when(kind == "ip", of(value=low, network=F.substring_index(low, ".", 2)))
        .when(kind == "card", of(value=digits, issuer=F.substring(digits, 1, 6)))
        .otherwise(of(value=digits, area=F.substring(digits, F.lit(1), F.length(digits) - 7)))
    )
    return F.filter(found, lambda x: x["name"] != "")


def disclosing_terms(docs: DataFrame, text: str = "text", reach: int = 8, min_contexts: int = 2, min_share: float = 0.5, min_bits: float = 6.0) -> DataFrame:
    """The words that give an entity away: term, kind, level, name, contexts, share, bits. Counts cover every row and whole text."""
    plain = docs.select(text_of(text).alias("text"))
    entity = ["kind", "level", "name"]
    spans = base_spans(plain, contexts=True, reach=reach).select(F.explode_outer("spans").alias("x")).filter("x is not null").select("x.kind", "x.value", "x.near")
    near = spans.select("kind", "near", F.explode(entities(F.col("kind"), F.col("value"))).alias("e")).select("kind", "e.level", "e.name", "near")
    contexts = near.groupBy(*entity, "near").agg(F.count(F.lit(1)).alias("n"))
    pairs = contexts.select(*entity, "n", F.explode(F.array_distinct("near")).alias("term")).groupBy(*entity, "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("together"))
    pairs = cut(pairs)
    candidates = pairs.filter(F.col("contexts") >= min_contexts)
    if candidates.isEmpty():
        return candidates.select("term", *entity, "contexts", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"))
    whole = pairs.groupBy(*entity).agg(F.sum("together").alias("near_entity"))
    words = plain.select(F.explode_outer(F.split("text", NOT_WORD)).alias("term")).filter("char_length(term) >= 3").select(F.lower("term").alias("term"))
    counts = cut(words.groupBy("term").agg(F.count(F.lit(1)).alias("occurs")))
    total = counts.agg(F.sum("occurs")).first()[0] or 1
    found = candidates.join(counts, "term").join(whole, entity)
    share = F.least(F.col("together") / F.col("occurs"), F.lit(1.0))  # one word can stand near two spans of an entity
    found = found.withColumn("share", share).withColumn("bits", F.log2(F.col("share") * F.lit(float(total)) / F.col("near_entity")))
    return found.filter((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).select("term", *entity, "contexts", "share", "bits")


def _term_spans(text: Column, terms: Column) -> Column:
    """All places of an array of words in a text."""

    def places(term: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), term, F.lit(r"(?![\p{L}\p{N}])"))
        values, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
        pair = F.arrays_zip(values.alias("value"), gaps.alias("gap"))
        pair = F.transform(F.filter(pair, lambda x: x["value"].isNotNull()), lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["value"]).alias("length"), x["value"].alias("value")))
        starts = running_starts(F.transform(pair, lambda x: x["gap"] + x["length"]))
        return F.zip_with(pair, starts, lambda x, s: F.struct(F.lit("term").alias("kind"), (s + x["gap"]).alias("start"), (s + x["gap"] + x["length"]).alias("end"), x["value"].alias("value")))

    return F.flatten(F.transform(terms, places))


def find_pii(docs: DataFrame, text: str = "text", spans: str = "pii_spans", literal_terms: int = 5000, **thresholds) -> DataFrame:
    """``docs`` with an array of struct<kind, start, end, value>, ordered by start, then kind.

    Up to ``literal_terms`` disclosing words are a set in the plan; more are joined to the different words of the different texts.
    """
    terms = cut(disclosing_terms(docs, text, **thresholds).select("term").distinct())
    tagged = base_spans(docs, text, spans)
    n = terms.count()
    if n:
        words, key, hits, rows = (free_name(tagged, x) for x in ("words", "row_key", "hits", "rows"))
        lower_words = F.transform(F.split(text_of(text), NOT_WORD), F.lower)
        if n <= literal_terms:
            known = [r["term"] for r in terms.collect()]
            tagged = tagged.withColumn(hits, F.array_distinct(F.filter(lower_words, lambda w: w.isin(known))))
        else:
            of_text = F.xxhash64(text_of(text), F.length(text_of(text)))
            texts = docs.select(of_text.alias(key), F.explode_outer(F.array_distinct(lower_words)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias(rows))
            found = cut(texts.join(terms, "term").groupBy(key).agg(F.collect_set("term").alias(hits), F.max(rows).alias(rows)))
            apart = [f.name for f in tagged.schema if f.name not in (text, spans) and "map<" not in f.dataType.simpleString()]
            tagged = salted_join(tagged.withColumns({key: of_text, words: F.xxhash64(*apart) if apart else F.lit(0)}), found, [key], rows, words, how="left").drop(key, words, rows)
            tagged = tagged.withColumn(hits, F.coalesce(hits, F.array().cast("array<string>")))
        extra = F.filter(_term_spans(text_of(text), F.col(hits)), lambda x: ~F.exists(F.col(spans), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        tagged = tagged.withColumn(spans, F.when(F.size(hits) > 0, F.concat(F.col(spans), extra)).otherwise(F.col(spans))).drop(hits)
    return tagged.withColumn(spans, in_order(F.col(spans)))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to ``<kind>`` and terms removed. Overlapping spans go as a whole, to the end of the last, each with its own mark."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.when(x["kind"] == "term", "").otherwise(F.concat(F.lit("<"), x["kind"], F.lit(">")))
        before = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.when(x["end"] > acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], before, new).alias("out"))).otherwise(acc)

    done = F.aggregate(spans, begin, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.char_length(text)))
