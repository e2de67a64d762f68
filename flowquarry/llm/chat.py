"""Preference formatting: one prompt for the turns two conversations share, and a masked completion of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


def clean_role(role: Column) -> Column:
    return F.coalesce(role, F.lit("user"))


def clean_text(text: Column) -> Column:
    """Null counts as empty; a text cannot open or close a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _rendered(turns: Column) -> Column:
    pieces = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n")))
    return F.array_join(pieces, "")


def _mask(turns: Column) -> Column:
    """``start:end`` of what the assistant says with its closing mark, in code points of the completion, comma-joined."""

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + len(OPEN) + F.char_length(t["role"]) + 1
        end = begin + F.char_length(t["text"]) + len(CLOSE)
        span = F.array(F.concat_ws(":", begin, end))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns the two have in common from the start, by role and text."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce(a == b, F.lit(False)))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda acc, s: F.struct((acc["n"] + (acc["on"] & s).cast("int")).alias("n"), (acc["on"] & s).alias("on"))
    return F.aggregate(same, start, step, lambda acc: acc["n"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, chosen, rejected)``, arrays of (role, text), as prompt and masked completions.

    Rows ``(pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)``. The longest
    common turn prefix is rendered once, as the prompt. Completions are the remaining turns of each; masks list
    the spans to learn from. A null role is a user's, a null text is empty, a null array has no turns;
    equal conversations have empty completions. Repeated rows stay; other columns are left out.
    """
    clean = {
        c: F.transform(F.coalesce(F.col(c), F.expr(f"cast(array() as {TURN})")), lambda t: F.struct(clean_role(t["role"]).alias("role"), clean_text(t["text"]).alias("text")))
        for c in ("chosen", "rejected")
    }
    turns = pairs.select("pair_id", *[v.alias(c) for c, v in clean.items()])
    cut = turns.withColumn("n", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0))) for c in clean}
    return cut.select("pair_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("prompt"), *[v.alias(c) for c, v in rest.items()]).select(
        "pair_id",
        F.col("n").alias("prompt_turns"),
        _rendered(F.col("prompt")).alias("prompt"),
        _rendered(F.col("chosen")).alias("chosen"),
        _mask(F.col("chosen")).alias("chosen_mask"),
        _rendered(F.col("rejected")).alias("rejected"),
        _mask(F.col("rejected")).alias("rejected_mask"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turns)`` from ``turns(conv_id, turn, role, text, ...)``, by turn, ties by role and text.

    A turn without a conv_id belongs to no other: each is a conversation of its own, with a null id.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    grouped = turns.select("conv_id", alone, "turn", "role", "text").groupBy("conv_id", "alone").agg(ordered.alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs ``(pair_id, chosen, rejected)``, one for each conversation of the table.

    Chosen is the conversation up to its last assistant turn; rejected ends in the last assistant turn of
    its neighbour instead, the conversation whose id differs in the lowest bit; ids that are not whole numbers
    have no neighbours. Without a neighbour that answers, rejected just lacks the last turn. A conversation without an assistant turn is rejected as
    it is, so its completions are empty.
    """
    grouped = conversations(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    marked = grouped.select("conv_id", "turns", F.coalesce(last, F.lit(0)).alias("last"))
    kind = turns.schema["conv_id"].dataType
    neighbour = F.col("conv_id").bitwiseXOR(F.lit(1).cast(kind)) if isinstance(kind, IntegralType) else F.lit(None).cast(kind)
    replies = marked.where("last > 0 and conv_id is not null").select(neighbour.alias("conv_id"), F.slice(F.col("turns"), F.col("last"), F.lit(1)).alias("other"))
    joined = marked.join(replies, "conv_id", "left")
    head = F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))
    none = F.expr(f"cast(array() as {TURN})")
    return joined.select(
        F.col("conv_id").alias("pair_id"),
        F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns")).alias("chosen"),
        F.when(F.col("last") > 0, F.concat(head, F.coalesce("other", none))).otherwise(F.col("turns")).alias("rejected"),
    )


def oracle() -> str:
    """The rows of ``format_pairs(reply_pairs(conversations))`` from SQL."""
    clean = "list_transform({}, lambda t: {{'role': coalesce(t.role, 'user'), 'text': replace(coalesce(t.text, ''), '<|', '< |')}})"
    render = f"coalesce(array_to_string(list_transform({{}}, lambda t: concat('{OPEN}', t.role, chr(10), t.text, '{CLOSE}', chr(10))), ''), '')"
    width = f"({len(OPEN) + len(CLOSE) + 2} + length(t.role) + length(t.text))"
    at = "coalesce(list_sum(list_transform({0}[1:i-1], lambda t: " + width + ")), 0)"
    begin = f"({at} + {len(OPEN) + 1} + length({{0}}[i].role))"
    span = f"concat(cast({begin} as bigint), ':', cast({begin} + length({{0}}[i].text) + {len(CLOSE)} as bigint))"
    mask = "coalesce(array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'), lambda i: " + span + "), ','), '')"
    return (
        "with g as (select conv_id, list({'role': role, 'text': text} order by turn, role, text) as turns from conversations group by conv_id), "
        "m as (select conv_id, turns, coalesce(list_max(list_transform(range(1, len(turns) + 1), lambda i: case when turns[i].role = 'assistant' then i end)), 0) as last from g), "
        "p as (select m.conv_id as pair_id, case when m.last > 0 then m.turns[1:m.last] else m.turns end as c, "
        "case when m.last > 0 then list_concat(m.turns[1:m.last-1], coalesce([o.turns[o.last]], [])) else m.turns end as r "
        "from m left join m o on o.last > 0 and o.conv_id = xor(m.conv_id, 1)), "
        f"q as (select pair_id, {clean.format('c')} as c, {clean.format('list_filter(r, lambda t: t is not null)')} as r from p), "
        "n as (select *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] is distinct from r[i])) - 1, len(c)) as n from q), "
        "s as (select pair_id, n, c[1:n] as p, c[n+1:] as c, r[n+1:] as r from n) "
        f"select pair_id, cast(n as integer) as prompt_turns, {render.format('p')} as prompt, {render.format('c')} as chosen, {mask.format('c')} as chosen_mask, "
        f"{render.format('r')} as rejected, {mask.format('r')} as rejected_mask from s"
    )
