import math
import random
from collections import Counter, defaultdict

from quorumlens.llm.url_filter import END, ORDER, RULES, START, UNKNOWN, judge_urls, text_scores


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [h + p for h, p, _ in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len, default=None)


def test_parts_rules_and_model(spark):
    r = random.Random(2)
    urls = [None, "", "nothing", "http://", "HTTP://ORG/", "x://Ünï.ORG/a?b#c", "a://b://c/d", "http://example.org/en/12", "http://xexample.org/en/1", "http://com/fr/", "http://a.com/fr", "http://q?x=/org/"]
    urls += [f"http://{r.choice(['good', 'nice'])}.org/{r.randint(0, 99)}" for _ in range(200)]
    urls += [f"http://bad-zzz{r.randint(0, 99)}.com/de/zzz" for _ in range(200)] + ["http://zzz-zzz.net/de/zzz", "http://good.org.good.orgx/77"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x["page_id"]: x for x in judge_urls(pages).collect()}
    assert len(got) == len(urls)
    verdicts = {h + p: v for h, p, v in RULES}
    for i, u in enumerate(urls):
        host, path, rule = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdicts[rule] if rule else got[i]["verdict"] in ("allow", "block")
    assert got[len(urls) - 2]["verdict"] == "block" and got[len(urls) - 1]["verdict"] == "allow"


def witten_bell(train, order):
    """The smoothed probability of a character after a context, from (text, n) pairs, in plain Python."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for text, n in train:
        t = START * order + text + END
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[k][t[i - k : i]][t[i]] += n

    def p(context, c):
        out = UNKNOWN
        for k in range(order + 1):
            seen = counts[k].get(context[len(context) - k :] if k else "")
            if seen:
                out = (seen[c] + len(seen) * out) / (sum(seen.values()) + len(seen))
        return out

    return p


def test_scores_equal_plain_witten_bell(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcé.-?=&#%/") for _ in range(r.randint(0, 9)))
    texts = [(f"http://{word()}", r.choice(["allow", "block", None]), r.randint(1, 4)) for _ in range(150)] + [("", None, 1), ("aA", None, 2)]
    texts = [(t, v, "score" if v is None else r.choice(["train", "train", "calibrate"]), n) for t, v, n in dict((x[0], x) for x in texts).values()]
    models = {x: witten_bell([(t.lower(), n) for t, v, part, n in texts if part == "train" and v == x], ORDER) for x in ("allow", "block")}
    got = {x["scored"]: x["score"] for x in text_scores(spark.createDataFrame(texts, "scored string, rule_verdict string, part string, n long")).collect()}
    assert set(got) == {t for t, _, part, _ in texts if part != "train"}
    for text, score in got.items():
        t = START * ORDER + text.lower() + END
        logs = [round(1e6 * math.log(models["allow"](t[i - ORDER : i], t[i]) / models["block"](t[i - ORDER : i], t[i]))) for i in range(ORDER, len(t))]
        assert abs(score - sum(logs) / len(logs) / 1e6) < 2e-6, text


def test_query_and_fragment_count_and_all_rows_stay(spark):
    rows = [(f"http://a{i}.org/x?{'nice' if i % 2 else 'good'}=1", 1) for i in range(60)] + [(f"http://a{i}.com/de/x?{'vile' if i % 2 else 'evil'}=1", 1) for i in range(60)]
    rows += [("http://b.net/x?nice=1", 0), ("http://b.net/x?vile=1", 0), ("nice", 0), ("vile", 0), (None, 0), ("http://b.net/x?vile=1", 0)] + [("http://hot.net/#evil", k) for k in range(1300)]
    pages = spark.createDataFrame([(u, k, "own", 1.0, 2) for u, k in rows], "url string, k long, host string, score double, n int")
    out = judge_urls(pages)
    assert out.columns == ["url", "k", "host", "score", "n", "_host", "path", "rule", "verdict", "_score"]
    got = [(x["url"], x["verdict"], x["host"], x["score"], x["n"]) for x in out.collect()]
    assert len(got) == len(rows) and {x[2:] for x in got} == {("own", 1.0, 2)}
    verdict = {x[0]: x[1] for x in got}
    assert (verdict["http://b.net/x?nice=1"], verdict["http://b.net/x?vile=1"], verdict["http://hot.net/#evil"]) == ("allow", "block", "block")
    assert (verdict["nice"], verdict["vile"]) == ("allow", "block") and None in verdict


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://x.net/"), (2, None)], "page_id long, url string")
    assert {x["verdict"] for x in judge_urls(pages).collect()} == {"allow"}
    assert judge_urls(pages.filter("page_id > 5")).count() == 0
