import hashlib
import itertools
import random
import re
import zlib

import pytest

from quorumlens.llm.chat_repair import repair, repair_conversations, replay
from quorumlens.llm.queries import damaged, op12_chat_repair

GOOD = re.compile(r"(s?(ua)+)?")


def brute(symbols):
    """The least (cost, audit) over all edits, with at most two insertions before each row and at the end: more never pay."""
    rows = [symbols[k : k + 2] for k in range(0, len(symbols), 2)]
    choices = []
    for initial, fault in rows:
        charge = 5 if fault == "t" else 0
        one = [("D", 2, "")]
        if fault in "t.":
            one += [("K", charge, initial), ("R", 1 + charge, "u"), ("R", 1 + charge, "a")]
        put = [("", 0, ""), ("I", 5, "u"), ("I", 5, "a"), ("II", 10, "ua"), ("II", 10, "au")]
        choices += [put, one]
    choices.append([("", 0, ""), ("I", 5, "u"), ("I", 5, "a"), ("II", 10, "ua"), ("II", 10, "au")])
    states = {("", ""): 0}  # (roles, audit): cost
    for options in choices:
        new = {}
        for (roles, audit), cost in states.items():
            for edit, price, role in options:
                key = (roles + role, audit + edit)
                new[key] = min(new.get(key, 10**9), cost + price)
        states = new
    return min((cost, audit) for (roles, audit), cost in states.items() if GOOD.fullmatch(roles))


def test_search_against_all_edits():
    r = random.Random(2)
    for _ in range(150):
        symbols = "".join(r.choice("usaax_") + r.choice("...tbd") for _ in range(r.randrange(4)))
        assert repair(symbols) == brute(symbols), symbols


def dynamic(symbols):
    """Costs and audits by dynamic programming over whole strings."""
    kept, put = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2)

    def inserted(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                new = (c + 5, a + "I")
                if put[s] not in best or new < best[put[s]]:
                    best[put[s]] = new
        return best

    best = inserted({0: (0, "")})
    for k in range(0, len(symbols), 2):
        initial, fault = symbols[k : k + 2]
        new = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 2, "D")]
            if fault in "t.":
                charge = 5 if fault == "t" else 0
                ways.append((put[s], c + 1 + charge, "R"))
                if initial in kept[s]:
                    ways.append((kept[s][initial], c + charge, "K"))
            for to, cost, edit in ways:
                if to not in new or (cost, a + edit) < new[to]:
                    new[to] = (cost, a + edit)
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def test_long_conversations():
    r = random.Random(3)
    for n in (5, 40, 400, 3000):
        for letters in ("ua", "usa", "u", "x", "uas."):
            symbols = "".join(r.choice(letters) + r.choice("....tbd") for _ in range(n))
            assert repair(symbols) == dynamic(symbols)
    cost, audit = repair("u." * 50_000)
    assert len(audit.replace("I", "")) == 50_000 and cost == 50_000 // 2
    assert GOOD.fullmatch("".join(role[0] if role else "u" for _, role in replay("u." * 50_000, audit)))


def plain(rows):
    """The contract over the rows of one conversation (after damage)."""
    if not rows:
        return [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, symbols = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "."
        seen.add((role, text))
        symbols.append((role[:1] or "_") + fault)
    roles = [s[0] for s in symbols]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    count = lambda f: sum(s[1] == f for s in symbols)
    cost, audit = dynamic("".join(symbols))
    lines, i, last = [], 0, ""
    for edit in audit:
        if edit == "K":
            lines.append(f"{rows[i][1]}:{rows[i][2]}")
            last = roles[i]
        elif edit != "D":
            last = "a" if last == "u" else "u"
            lines.append(("user" if last == "u" else "assistant") + ":" + (rows[i][2] if edit == "R" else ""))
        i += edit != "I"
    return [gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]


def conversations():
    r = random.Random(4)
    text = lambda: r.choice(["Hi.", "Yes!", "no", "", " \t", None, "What?\n", "cut off ", "Ünï.", "a" * 5000 + ".", "end. "])
    role = lambda: r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"])
    rows = [(c, r.choice([k, k, k, k + 3, None]), role(), text()) for c in range(250) for k in range(r.randrange(1, 9))]
    rows += [(None, k, role(), text()) for k in range(20)] + [(700, None, "user", "Hi.")] * 3 + [(701, 0, "user", "Hi."), (701, 0, "user", "Hi.")]
    rows += [(702, k, "assistant" if k % 2 else "user", f"Turn {k}.") for k in range(700)]
    return rows


def damage(rows):
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


@pytest.mark.parametrize("parts", [1, 7])
def test_query_against_the_contract(spark, tmp_path, parts):
    rows = conversations()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x[0]: list(x)[1:] for x in op12_chat_repair(spark, str(tmp_path)).collect()}
    groups = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        groups[conv].append(row)
    assert got == {conv: plain(group) for conv, group in groups.items()}


def test_turns_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, place int, symbol string"
    turns = spark.createDataFrame([(1, 0, "user", "Hi.", 9, "x"), (1, 1, "user", "Oh.", 9, "x"), (1, 2, "user", "Oh.", 9, "x"), (2, 0, "assistant", "cut", 9, "x")], schema)
    reports, after = repair_conversations(turns)
    assert sorted((x.conv_id, x.cost, x.audit) for x in reports.collect()) == [(1, 3, "KRD"), (2, 2, "D")]
    assert sorted((x.conv_id, x.place, x.role, x.text, x.edit) for x in after.collect()) == [(1, 0, "user", "Hi.", "keep"), (1, 1, "assistant", "Oh.", "rerole")]
    none = spark.createDataFrame([], schema)
    reports, after = repair_conversations(damaged(none))
    assert reports.count() == 0 and after.count() == 0
