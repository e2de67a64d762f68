"""Secret scans with a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import broadcast_if_small, stored


@dataclass(frozen=True)
class Rule:
    """A regular expression that Java, RE2 and Python read alike, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, then kinds of well-known public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: The same rules for masking, where a private key is gone whole, up to its END line if it has one.
WHOLE_KEY_RULES = (
    Rule("private_key", RULES[-1].pattern + r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----)?"),
    *RULES[:-1],
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Spelled-out strings that a piece of a regular expression may stand for, at most.
MAX_STRINGS = 48
#: Candidate rows up to this number are broadcast; beyond it they meet the documents in a shuffle join.
BROADCAST_ROWS = 1_000_000

#: A trigram query: True, a trigram, ("and", queries) or ("or", queries).
Query = bool | str | tuple


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    sets = {p: set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts}
    parts = [p for p in parts if not any(sets[q] < sets[p] for q in parts)]  # what asks for more adds nothing
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What must be present if one of the strings is."""
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _spelled(op: object, value: object) -> set[str] | None:
    """All strings a piece stands for, lower-cased; None where they are too many."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 8:
        return {chr(v).lower() for _, v in value}
    if op is sre.SUBPATTERN:
        return _spelled_all(list(value[-1]))
    if op is sre.BRANCH:
        sides = [_spelled_all(list(side)) for side in value[1]]
        return None if None in sides else set().union(*sides)
    if op is sre.MAX_REPEAT and value[1] == 1:
        once = _spelled_all(list(value[2]))
        return None if once is None else once | ({""} if value[0] == 0 else set())
    return None


def _spelled_all(pieces: list) -> set[str] | None:
    strings = {""}
    for op, value in pieces:
        more = _spelled(op, value)
        if more is None or len(strings) * len(more) > MAX_STRINGS:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _required(pieces: list) -> Query:
    parts, run = [], {""}
    for op, value in pieces:
        more = _spelled(op, value)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_of_strings(run))
        run = more if more is not None else {""}
        if more is None and op is sre.SUBPATTERN:
            parts.append(_required(list(value[-1])))
        elif more is None and op is sre.BRANCH:
            parts.append(_any_of([_required(list(side)) for side in value[1]]))
        elif more is None and op is sre.MAX_REPEAT and value[0] > 0:
            parts.append(_required(list(value[2])))
    return _all_of([*parts, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-cased trigrams that every match of the pattern satisfies; True if there is none."""
    return _required(list(sre_parser.parse(pattern)))


def trigrams(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*map(trigrams, query[1]))
    return set() if query is True else {query}


def _holds(query: Query, present: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(present, query)
    sides = [_holds(q, present) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, sides)


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct, its text and a row key. Rows with the same id and text share a key and its postings."""
    return docs.select(
        F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("body"), F.xxhash64("doc_id", "text").alias("row_key")
    )


def postings(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index ``(trigram, row_key)`` over the trigrams that the rules' queries name."""
    wanted = sorted(set().union(*[trigrams(trigram_query(r.pattern)) for r in rules]))
    low = keyed.select("row_key", F.lower("body").alias("low"))
    hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("row_key", F.explode(hits).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows ``(row_key, kinds)`` whose postings satisfy a rule's query, with the kinds they may hold."""
    by_key = index.groupBy("row_key").agg(F.collect_set("trigram").alias("present"))
    indexed = [r for r in rules if trigram_query(r.pattern) is not True]
    kinds = F.array_compact(
        F.array(*[F.when(_holds(trigram_query(r.pattern), F.col("present")), F.lit(r.kind)) for r in indexed])
    )
    return by_key.select("row_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, rule: Rule) -> Column:
    """An array of the leftmost matches: the text before each, the match, and its group whose length counts.

    The last element has only the text after all matches. Each pattern runs over the text a fixed number of times.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole")
    tested = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("tested")] if rule.group else []
    return F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), whole, *tested)


def _long_enough(match: Column, rule: Rule) -> Column:
    return F.char_length(match["tested" if rule.group else "whole"]) >= rule.least


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Code-point spans of the rule's leftmost matches that are long enough.

    Places are running sums of lengths. They are taken over runs of about the square root of the matches
    and then within each, so a text of n matches takes steps in proportion to the power 1.5 of n.
    """
    none = F.expr(f"cast(array() as {SPAN})")
    sized = F.transform(
        F.filter(_matches(text, rule), lambda m: m["whole"].isNotNull()),
        lambda m: F.struct(F.char_length(m["before"]).alias("gap"), F.char_length(m["whole"]).alias("size"), _long_enough(m, rule).alias("fits")),
    )

    def in_runs(sizes: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(sizes))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, run), lambda at: F.slice(sizes, at + 1, run))

    def starts(runs: Column) -> Column:
        lengths = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda total, m: total + m["gap"] + m["size"]))
        first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("list"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list"))
        return F.aggregate(lengths, first, step, lambda acc: acc["list"])

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["size"]
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(m["fits"], F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def placed(runs: Column) -> Column:
        each = F.arrays_zip(runs.alias("run"), starts(runs).alias("start"))
        return F.flatten(F.transform(each, lambda r: F.aggregate(r["run"], F.struct(r["start"].alias("at"), none.alias("found")), step, lambda acc: acc["found"])))

    scanned = _bound(sized, lambda sizes: _bound(in_runs(sizes), placed))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), scanned).otherwise(none)


def _candidate_docs(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    keyed = with_key(docs)
    index = stored(postings(keyed, rules), "trigram-postings")
    found = stored(candidates(index, rules), "secret-candidates")
    return keyed.join(broadcast_if_small(found, BROADCAST_ROWS), "row_key", "left")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows ``(doc, found)``: each row of ``docs(doc_id, text, ...)`` as a struct, and its spans by start, then rule.

    Spans are ``(start, rank, end)`` in code points, end exclusive; rank is the rule's place in ``rules``.
    A rule with mandatory trigrams is verified only where the index admits it, the others scan every
    text. A null or empty text has no spans; repeated rows each keep theirs; extra columns stay inside
    ``doc`` and clash with nothing; an empty table gives an empty result.
    """
    joined = _candidate_docs(docs, rules)
    none = F.expr(f"cast(array() as {SPAN})")
    each = []
    for rank, rule in enumerate(rules):
        own = spans(F.col("body"), rule, rank)
        indexed = trigram_query(rule.pattern) is not True
        each.append(F.when(F.array_contains("kinds", rule.kind), own).otherwise(none) if indexed else own)
    return joined.select("doc", F.array_sort(F.concat(*each)).alias("found"))


def listing(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def _masked(text: Column, rule: Rule) -> Column:
    mask = lambda m: F.when(m["whole"].isNull(), F.lit("")).when(_long_enough(m, rule), F.lit(f"<{rule.kind.upper()}>")).otherwise(m["whole"])
    return F.array_join(F.transform(_matches(text, rule), lambda m: F.concat(m["before"], mask(m))), "")


def _mask_if(text: Column, admitted: Column, rule: Rule) -> Column:
    """The masked text. A lambda names the text, so that rule upon rule makes the expression longer but not wider."""
    found = lambda t: admitted & F.regexp_like(t, F.lit(rule.pattern))
    return _bound(text, lambda t: F.when(found(t), _masked(t, rule)).otherwise(t))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in angle brackets, one rule after the other.

    Null texts stay null; every row and column stays; ``n_chars``, where there is one, follows the text.
    """
    out = _candidate_docs(docs, rules)
    for rule in rules:
        admitted = F.lit(True) if trigram_query(rule.pattern) is True else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        out = out.withColumn("body", _mask_if(F.col("body"), admitted, rule))
    text = F.when(F.col("doc.text").isNotNull(), F.col("body"))
    columns = {"text": text, "n_chars": F.when(F.col("doc.text") == F.col("body"), F.col("doc.n_chars")).otherwise(F.char_length(text).cast("long"))}
    return out.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def digest_columns(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    found = F.col("found")
    ranks = {r.kind: n for n, r in enumerate(rules)}
    base = [ranks[k] for k in BASE_KINDS]

    def count(rank: int) -> Column:
        return F.size(F.filter(found, lambda s: s["rank"] == rank)).cast("long")

    counts = [count(ranks[k]).alias(f"n_{k}") for k in BASE_KINDS]
    base_text = listing(F.filter(found, lambda s: s["rank"].isin(base)), rules)
    return scanned.select(
        F.col("doc.doc_id").alias("doc_id"),
        *counts,
        F.sha2(base_text.cast("binary"), 256).alias("base_sha256"),
        listing(found, rules).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows from SQL, by a full scan of every rule."""
    quoted = {r.kind: r.pattern.replace("'", "''") for r in rules}
    pieces = ", ".join(
        f"string_split_regex(body, '{quoted[r.kind]}') as b{n}, regexp_extract_all(body, '{quoted[r.kind]}', 0) as w{n}, "
        f"regexp_extract_all(body, '{quoted[r.kind]}', {r.group}) as t{n}"
        for n, r in enumerate(rules)
    )
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    lists = ", ".join(
        f"list_transform(list_filter(range(1, len(w{n}) + 1), lambda i: length(t{n}[i]) >= {r.least}), lambda i: "
        f"{{'start': cast({total.format(f'b{n}[1:i]')} + {total.format(f'w{n}[1:i-1]')} as bigint), 'rank': {n}, "
        f"'end': cast({total.format(f'b{n}[1:i]')} + {total.format(f'w{n}[1:i]')} as bigint)}})"
        for n, r in enumerate(rules)
    )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    text = f"list_transform({{}}, lambda s: concat({kinds}[s.rank + 1], ':', s.start, ':', s.end))"
    base = "list_filter(found, lambda s: s.rank < 3)"
    counts = ", ".join(f"cast(len(list_filter(found, lambda s: s.rank = {n})) as bigint) as n_{k}" for n, k in enumerate(BASE_KINDS))
    return (
        f"with d as (select doc_id, coalesce(text, '') as body from documents), m as (select doc_id, {pieces} from d), "
        f"s as (select doc_id, list_sort(flatten([{lists}])) as found from m) "
        f"select doc_id, {counts}, sha256(coalesce(array_to_string({text.format(base)}, ','), '')) as base_sha256, "
        f"coalesce(array_to_string({text.format('found')}, ','), '') as spans from s"
    )
