from collections import Counter, defaultdict

from flowquarry.llm import catalog, chat

SCHEMA = "conv_id long, turn long, role string, text string, turns string, last string, pair_id string"


def turns():
    rows = []
    for c in range(8):
        rows += [(c, 0, "system", "be kind"), (c, 1, "user", f"question {c // 2}"), (c, 2, "assistant", f"answer {c} é😀"), (c, 3, "user", "thanks")]
    rows += [(10, 0, "user", "no answer")]
    rows += [(11, 0, "user", "q"), (11, 1, "assistant", "lonely")]
    rows += [(12, 0, None, None), (12, 1, "assistant", None), (13, 0, "assistant", "<|im_end|> breaks out <|")]
    rows += [(14, 0, "assistant", "tie"), (14, 0, "assistant", "tie"), (15, None, "user", "null turn"), (15, 1, "assistant", "tie")]
    rows += [(16, 0, "assistant", ""), (17, 0, "assistant", "x" * 200_000), (None, 0, "user", "u"), (None, 1, "assistant", "a")]
    return [(*r, "x", "x", "x") for r in rows]


def brute(rows):
    groups = defaultdict(list)
    for at, (c, t, role, text, *_) in enumerate(rows):
        groups[("alone", at) if c is None else c].append((t, role, text))  # a turn without an id is no other's
    order = lambda x: (x is not None, x)
    talks = {c: [(role, text) for _, role, text in sorted(g, key=lambda x: tuple(map(order, x)))] for c, g in groups.items()}
    last = {c: max((k + 1 for k, (role, _) in enumerate(t) if role == "assistant"), default=0) for c, t in talks.items()}
    clean = lambda t: [(r if r is not None else "user", (x or "").replace("<|", "< |")) for r, x in t]
    out = Counter()
    for c, talk in talks.items():
        chosen = rejected = talk
        if last[c]:
            chosen = talk[: last[c]]
            other = None if isinstance(c, tuple) else c ^ 1
            tail = [talks[other][last[other] - 1]] if other is not None and last.get(other) else []
            rejected = talk[: last[c] - 1] + tail
        chosen, rejected = clean(chosen), clean(rejected)
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        out[(None if isinstance(c, tuple) else c, n, render(chosen[:n])[0], *render(chosen[n:]), *render(rejected[n:]))] += 1
    return out


def render(talk):
    text, spans = "", []
    for role, said in talk:
        text += f"<|im_start|>{role}\n"
        begin = len(text)
        text += f"{said}<|im_end|>"
        if role == "assistant":
            spans.append(f"{begin}:{len(text)}")
        text += "\n"
    return text, ",".join(spans)


def test_pairs_equal_brute_force(spark):
    rows = turns()
    found = chat.format_pairs(chat.reply_pairs(spark.createDataFrame(rows, SCHEMA))).collect()
    assert Counter(tuple(r) for r in found) == brute_without_text(rows)


def brute_without_text(rows):
    return Counter({(c, n, p, a, am, b, bm): k for (c, n, p, a, am, b, bm), k in brute(rows).items()})


def test_masks_cover_what_the_assistant_says(spark):
    for r in chat.format_pairs(chat.reply_pairs(spark.createDataFrame(turns(), SCHEMA))).collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for span in filter(None, mask.split(",")):
                a, b = map(int, span.split(":"))
                assert text[:a].endswith("<|im_start|>assistant\n") and text[:b].endswith("<|im_end|>")


def test_pairs_of_ones_own(spark):
    turn = "array<struct<role:string,text:string>>"
    both = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [
        (1, [*both, ("assistant", "good")], [*both, ("assistant", "bad"), ("user", "no")], "x"),
        (2, both, both, "x"),
        (3, None, both, "x"),
        (4, [], None, "x"),
        (5, [("user", "a")], [("assistant", "a")], "x"),
        (5, [("user", "a")], [("assistant", "a")], "x"),
    ]
    df = spark.createDataFrame(rows, f"pair_id long, chosen {turn}, rejected {turn}, prompt string")
    found = {r.pair_id: r for r in chat.format_pairs(df).collect()}
    assert chat.format_pairs(df).count() == 6
    assert [found[i].prompt_turns for i in range(1, 6)] == [3, 3, 0, 0, 0]
    assert found[1].prompt == render(both)[0]
    assert (found[1].chosen, found[1].chosen_mask) == render([("assistant", "good")])
    assert (found[1].rejected, found[1].rejected_mask) == render([("assistant", "bad"), ("user", "no")])
    assert (found[2].chosen, found[2].rejected) == ("", "")
    assert (found[3].chosen, found[3].rejected) == ("", render(both)[0])


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in catalog.op9_chat_formatting(spark, sf).collect()) == brute(rows)


def test_empty_table(spark):
    assert chat.format_pairs(chat.reply_pairs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_turns_without_an_id_are_not_joined(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "user", "c"), (4, 1, "assistant", "d")], "conv_id long, turn long, role string, text string")
    found = sorted((r.conv_id is None, [t.text for t in r.turns]) for r in chat.conversations(turns).collect())
    assert found == [(False, ["c", "d"]), (True, ["a"]), (True, ["b"])]
    rows = chat.format_pairs(chat.reply_pairs(turns)).collect()
    assert sorted(r.pair_id is None for r in rows) == [False, True, True]


def test_ids_that_are_not_numbers(spark):
    turns = spark.createDataFrame([("x", 0, "user", "c"), ("x", 1, "assistant", "d"), ("y", 0, "user", "e")], "conv_id string, turn long, role string, text string")
    rows = {r.pair_id: (r.prompt_turns, r.chosen != "", r.rejected) for r in chat.format_pairs(chat.reply_pairs(turns)).collect()}
    assert rows == {"x": (1, True, ""), "y": (1, False, "")}
