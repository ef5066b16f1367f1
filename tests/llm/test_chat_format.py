import random

from quorumlens.llm.chat_format import format_chats, read_back


def test_round_trip_and_mask(spark):
    r = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "é", "😀", "\n", "a", "</\\s>", ""]
    rows = []
    for conv in range(120):
        for turn in range(r.randint(1, 9)):
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "</s>", "[INST]"]), r.choice([None, "".join(r.choices(bits, k=r.randint(0, 8)))])))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(999, t, "assistant" if t % 3 else "user", f"t{t}</s>") for t in range(1500)]
    rows += [(None, None, None, None), (5000, 1, "user", "b"), (5000, 1, "user", "a")]
    turns = spark.createDataFrame([(c, t, ro, x, "more") for c, t, ro, x in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = format_chats(turns).cache()
    masks = {x["conv_id"]: x for x in formatted.collect()}
    for got in read_back(formatted).collect():
        want = sorted([(t if t is not None else -1, ro or "", x or "") for c, t, ro, x in rows if c == got["conv_id"]])
        assert [(t["role"], t["text"]) for t in got["turns"]] == [w[1:] for w in want]
        assert got["loss_text"] == "".join(w[2] for w in want if w[1] == "assistant")
        m = masks[got["conv_id"]]
        under = [m["formatted"][s["start"] : s["start"] + s["length"]] for s in m["loss_spans"]]
        assert len(under) == sum(w[1] == "assistant" for w in want) and m["n_turns"] == len(want)
    assert len(masks) == len({c for c, *_ in rows})


def test_blocks_and_query_with_turns_without_conversation(spark, tmp_path):
    from quorumlens.llm.queries import op10_chat_format

    rows = [(None, 0, "user", "lost?"), (None, 1, "assistant", "no"), (1, 0, "assistant", "a"), (1, 1, "assistant", None), (1, 2, "user", "b"), (1, 3, "assistant", "<s>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x["conv_id"]: x for x in op10_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {None, 1, -7} and (got[None]["n_turns"], got[None]["loss_chars"], got[1]["loss_chars"]) == (2, 2, 4)
    made = {x["conv_id"]: x for x in format_chats(turns).collect()}
    assert made[1]["formatted"] == "[INST]assistant[/INST]a<s></s>[INST]user[/INST]b</s>[INST]assistant[/INST]<\\s></s>" and made[1]["n_blocks"] == 3


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
