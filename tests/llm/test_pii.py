import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quorumlens.llm.pii import disclosing_terms, find_pii, sanitise, span_list


def brute(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for rank, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            if kind == "ip" and any(int(p) > 255 for p in v.split(".")):
                continue
            if kind == "card":
                s = sum((2 * int(c) - 9 * (int(c) > 4) if i % 2 else int(c)) for i, c in enumerate(reversed(d)))
                if not 12 <= len(d) <= 19 or s % 10:
                    continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def texts():
    r = random.Random(5)
    parts = ["a@b.c", "a@b", "x_y@c.d-e.f", "@", ".", "_d@e.f", "é", " ", "-", "+1 (555) 010-9999", "+12", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", "0" * 13, "\n", "😀", "+", "%", "(", ")", "12345678901234567890"]
    return [None, "", "7" * 30_000, "a" * 50_000, "+1" + "(" * 5000] + ["".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(400)]


def test_base_spans_equal_plain_regular_expressions(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r[0]: r[1] for r in find_pii(docs).select("doc_id", span_list(F.col("pii_spans"))).collect()}
    for i, t, _ in rows:
        assert got[i] == brute(t or ""), t


def planted():
    rows = [(i, f"{w} met at the old harbour Zanzibrook near bob@x.org then {w}s left") for i, w in enumerate(["One", "Two", "Six", "Ten"])]
    return rows + [(10, "zanzibrook stands alone; the old harbour"), (11, "the old harbour, the old man, the old then"), (12, "the old harbour near then met left " * 10), (13, None)] + [(20 + i, f"filler words number{i} only here") for i in range(4000)]


def plain_terms(texts, reach, min_contexts, min_share, min_bits):
    """Disclosing words by counting in plain Python."""
    word = re.compile(r"[^\W_]{3,}")
    occurs, contexts = Counter(), Counter()
    for t in texts:
        occurs.update(w.lower() for w in word.findall(t))
        for kind in ("email", "ip"):
            found = list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+" if kind == "email" else r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}", t))
            for k, m in enumerate(found):
                before = t[found[k - 1].end() if k else 0 : m.start()]
                after = t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)]
                near = tuple([w.lower() for w in word.findall(before)][::-1][:reach] + [w.lower() for w in word.findall(after)][:reach])
                v = m.group().lower()
                names = {"value": v, "holder": re.sub("[^a-z]", "", v.split("@")[0]), "domain": v.split("@")[-1]} if kind == "email" else {"value": v, "network": ".".join(v.split(".")[:2])}
                contexts.update((kind, level, name, near) for level, name in names.items() if name)
    pairs, near_entity = defaultdict(lambda: [0, 0]), Counter()
    for (*e, near), n in contexts.items():
        for w in set(near):
            pairs[*e, w][0] += 1
            pairs[*e, w][1] += n
            near_entity[tuple(e)] += n
    out = {}
    for (*e, w), (seen, n) in pairs.items():
        share = min(n / occurs[w], 1.0)
        bits = math.log2(share * sum(occurs.values()) / near_entity[tuple(e)])
        if seen >= min_contexts and share >= min_share and bits >= min_bits:
            out[w, *e] = (seen, round(share, 9), round(bits, 9))
    return out


def test_terms_equal_plain_counting(spark):
    r = random.Random(9)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]
    entity = lambda: r.choice([f"ana{r.randint(1, 3)}@box{r.randint(1, 2)}.org", f"Bob@box{r.randint(1, 9)}.org", f"10.{r.randint(1, 3)}.0.{r.randint(1, 4)}", "999.1.1.1x"])
    texts = [" ".join(x for k in range(r.randint(1, 4)) for x in (*r.choices(words, k=r.randint(0, 12)), entity())).replace("999.1.1.1x", "plain") for _ in range(400)]
    texts = [t + " x" * 2000 + " far@away.net" if k % 50 == 0 else t for k, t in enumerate(texts)] + texts[:20]
    options = {"reach": 3, "min_contexts": 2, "min_share": 0.03, "min_bits": 1.0}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["term"], x["kind"], x["level"], x["name"]): (x["contexts"], round(x["share"], 9), round(x["bits"], 9)) for x in disclosing_terms(docs, **options).collect()}
    want = plain_terms(texts, **options)
    assert len(want) > 50 and {k[2] for k in want} == {"value", "holder", "domain", "network"} and got == want


def test_clashing_names_and_a_mass_copied_text(spark):
    rows = planted() + [(9000 + i, "Zanzibrook and bob@x.org") for i in range(1500)]
    docs = spark.createDataFrame([(i, t, 1, "r", "w") for i, t in rows], "doc_id long, text string, rows int, row_key string, words string")
    outs = [{x["doc_id"]: (span_text(x), x["rows"], x["row_key"]) for x in find_pii(docs, literal_terms=n, min_bits=0.5, min_share=0.9).collect()} for n in (5000, 0)]
    assert outs[0] == outs[1] and len(outs[0]) == len(rows) and outs[0][9000][0].startswith("term:0:10,") and outs[0][9000][1:] == (1, "r")


def span_text(row):
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in row["pii_spans"])


def test_disclosing_terms_are_found_and_removed(spark):
    docs = spark.createDataFrame(planted(), "doc_id long, text string")
    for bound in (5000, 0):
        out = {r["doc_id"]: r for r in find_pii(docs, literal_terms=bound).withColumn("clean", sanitise(F.coalesce("text", F.lit("")), F.col("pii_spans"))).collect()}
        assert [x["kind"] for x in out[0]["pii_spans"]] == ["term", "email"]
        assert out[10]["clean"] == " stands alone; the old harbour"
        assert out[11]["pii_spans"] == [] and out[13]["pii_spans"] == []
        assert out[0]["clean"] == "One met at the old harbour  near <email> then Ones left"


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_character_of_a_base_span_survives(spark):
    r = random.Random(9)
    part = lambda: r.choice(["10.0.0.1", "-4111111111110005", "4111 1111 1111 1111", "+49 (30) 123-4567", "a.b@c.de", ".x", " ", "-", "1", "+1", "8.8.8.8"])
    texts = ["ip 10.0.0.1-4111111111110005 end", *("ab " + "".join(part() for _ in range(r.randrange(1, 9))) + " yz" for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    overlaps = 0
    for x in find_pii(docs).withColumn("clean", sanitise(F.col("text"), F.col("pii_spans"))).collect():
        covered = {k for s in x["pii_spans"] for k in range(s["start"], s["end"])}
        overlaps += len(covered) < sum(s["end"] - s["start"] for s in x["pii_spans"])
        left = re.sub("<(email|ip|card|phone)>", "", x["clean"])
        assert left == "".join(c for k, c in enumerate(x["text"]) if k not in covered)
    assert overlaps > 10
