"""Mixing to target weights with soft domain membership. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import broadcast_if_small, stored

#: Domains as conditions on a row of the labels table; the first that holds counts.
DOMAINS = {"toxic": "toxic = 1", "low": "quality = 0", "clean": "quality = 1"}
#: Target domain tokens, as multiples of what the corpus is expected to hold of the domain.
TARGETS = {"toxic": 0.25, "low": 1.0, "clean": 1.2}
#: A token that every row brings once, to count rows that share a key.
ROW = "\u0001"
BROADCAST_ROWS = 1_000_000
#: Step lengths that a round of the rate solver tries.
LENGTHS = (1.0, 0.5, 0.2, 0.05)


@dataclass(frozen=True)
class Classifier:
    """``words(word, rows, w_<domain>...)`` with log-likelihoods against the corpus, log priors, and the evidence bound."""

    words: DataFrame
    priors: dict[str, float]
    evidence: float


def words_of(text: Column) -> Column:
    """Lower-cased words between white space; runs of two or more marks count as words of their own.

    A text that begins or ends in white space, and an empty one, also give empty words, which are in no word table.
    """
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([^\p{L}\p{N}\s]{2,})", " $1 ")
    return F.split(apart, r"\s+")


def n_tokens(text: Column) -> Column:
    """The number of words between white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 8_000, max_words: int = 20_000, least: int = 4, evidence: float = 60.0
) -> Classifier:
    """A naive Bayes word classifier from the labels table.

    It sees a bounded sample: labelled ids are drawn by a hash so that about ``sample_rows`` come in (all,
    where there are fewer). The ``max_words`` most frequent words with ``least`` occurrences stay, so the
    word table may be broadcast. An id with several labels counts as toxic or low if one of them says so.
    Null labels are left out; without labels all domains are equally likely.
    """
    by_id = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = reduce(lambda c, d: c.when(F.expr(d[1]), d[0]), list(DOMAINS.items())[1:], F.when(F.expr(next(iter(DOMAINS.values()))), next(iter(DOMAINS))))
    known = by_id.select("doc_id", domain.alias("domain")).where("domain is not null")
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < min(1.0, sample_rows / max(total, 1)))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    counted = [F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]
    counts = texts.select("domain", F.explode(words_of(F.col("text"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), *counted)
    top = stored(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(max_words), "domain-words")
    sums = top.agg(F.count("*").alias("v"), F.sum("n").alias("n"), *[F.sum(d).alias(d) for d in DOMAINS]).first()
    size = (sums["v"] or 0) + 1
    overall = F.log((F.col("n") + 1) / float((sums["n"] or 0) + size))
    weights = [(F.log((F.col(d) + 0.5) / ((sums[d] or 0) + 0.5 * size)) - overall).alias(f"w_{d}") for d in DOMAINS]
    spark = docs.sparkSession
    row = spark.range(1).select(F.lit(ROW).alias("word"), F.lit(1).alias("rows"), *[F.lit(0.0).alias(f"w_{d}") for d in DOMAINS])
    table = top.select("word", F.lit(0).alias("rows"), *weights).union(row)
    return Classifier(table, {d: log((sizes.get(d, 0) + 1) / (total + len(DOMAINS))) for d in DOMAINS}, evidence)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """Rows ``(doc_id, row_key, copies, n_tokens, p_<domain>...)``, one for each distinct id and text.

    Words are summed beside their text before anything is shuffled, and the word table is broadcast, which
    its bound allows. A text weighs as at most ``evidence`` words, so long texts keep soft posteriors.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), n_tokens(text).alias("n_tokens"), F.concat(F.array(F.lit(ROW)), words_of(text)).alias("words"))
    each = rows.select("doc_id", "row_key", "n_tokens", F.explode("words").alias("word")).join(F.broadcast(model.words), "word")
    sums = each.groupBy("doc_id", "row_key").agg(
        F.sum("rows").alias("copies"), F.max("n_tokens").alias("n_tokens"), *[F.sum(f"w_{d}").alias(f"s_{d}") for d in DOMAINS]
    )
    share = F.least(F.lit(1.0), F.lit(model.evidence) / F.greatest("n_tokens", F.lit(1))) / F.col("copies")
    scored = sums.select("doc_id", "row_key", "copies", "n_tokens", *[(F.lit(model.priors[d]) + F.col(f"s_{d}") * share).alias(f"s_{d}") for d in DOMAINS])
    top = F.greatest(*[F.col(f"s_{d}") for d in DOMAINS])
    odds = [F.exp(F.col(f"s_{d}") - top) for d in DOMAINS]
    return scored.select("doc_id", "row_key", "copies", "n_tokens", *[(o / reduce(add, odds)).alias(f"p_{d}") for d, o in zip(DOMAINS, odds, strict=True)])


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """A small symmetric linear system; the shortest of the solutions nearest to it where ``a`` is singular."""
    return (np.linalg.pinv(np.array(a), rcond=1e-9, hermitian=True) @ np.array(b)).tolist()


def likeliest(domains: tuple[str, ...]) -> Column:
    """Whether one of the domains has the row's greatest posterior."""
    top = F.greatest(*[F.col(f"p_{d}") for d in DOMAINS])
    return reduce(lambda c, d: c | (F.col(f"p_{d}") == top), domains, F.lit(False))


def rates(
    members: DataFrame, targets: dict[str, float] | None = None, stay: tuple[str, ...] = (), tolerance: float = 1e-6, rounds: int = 20
) -> DataFrame:
    """``members`` and a nonnegative ``rate`` for each, whose expected domain token totals meet the targets.

    Rows whose likeliest domain is one of ``stay`` have a rate of 1 at least; the others make up for it.
    Least squares over the residuals of the domains' totals, by projected gradients from rate 1: a step
    moves each rate by its posteriors times the residuals, weighed by the inverse of the domains' Gram
    matrix, and then rates below their bound are put to it. The matrix of the rows above their bounds takes few
    rounds but may overshoot, that of all rows is always safe at length 1; so a round tries the
    first at several ``LENGTHS`` and the second, and takes the best. It is one aggregation of a few numbers;
    the rates themselves are an expression over the member's own row, so nothing is passed from row to
    row. It ends at ``tolerance`` times the targets' sum, or where a round gains less than a thousandth
    (targets out of reach), or after ``rounds``.
    """
    targets = TARGETS if targets is None else targets
    names = list(DOMAINS)
    p = {d: F.col(f"p_{d}") for d in names}
    weight = (F.col("copies") * F.col("n_tokens")).cast("double")
    least = F.when(likeliest(stay), 1.0).otherwise(0.0) if stay else F.lit(0.0)

    def totals(trials: list[Column]) -> list[tuple[list[float], list[list[float]]]]:
        """For each trial the expected tokens of the domains, and the Gram matrix of the rows above their bounds."""
        sums = []
        for n, _ in enumerate(trials):
            r = F.col(f"rate_{n}")
            sums += [F.sum(weight * p[d] * r).alias(f"{n}_{d}") for d in names]
            sums += [F.sum(F.when(r > least, weight * p[a] * p[b])).alias(f"{n}_{a}_{b}") for a in names for b in names]
        row = members.select("*", *[t.alias(f"rate_{n}") for n, t in enumerate(trials)]).agg(*sums).first()
        return [([row[f"{n}_{d}"] or 0.0 for d in names], [[row[f"{n}_{a}_{b}"] or 0.0 for b in names] for a in names]) for n, _ in enumerate(trials)]

    rate = F.lit(1.0)
    [(now, _)] = totals([rate])
    [row] = members.agg(*[F.sum(weight * p[a] * p[b]).alias(f"{a}_{b}") for a in names for b in names]).collect()
    whole = [[row[f"{a}_{b}"] or 0.0 for b in names] for a in names]
    goal = [targets[d] * t for d, t in zip(names, now, strict=True)]
    miss, matrix = [x - t for x, t in zip(now, goal, strict=True)], whole

    def misfit(miss: list[float]) -> float:
        return sum(x * y for x, y in zip(miss, solve(whole, miss), strict=True))

    for _ in range(rounds):
        if max(map(abs, miss)) <= tolerance * max(sum(goal), 1.0):
            break
        steps = [solve(whole, miss)]
        if matrix is not whole:
            steps += [[x * length for x in solve(matrix, miss)] for length in LENGTHS]
        trials = [F.greatest(least, rate - reduce(add, [p[d] * x for d, x in zip(names, step, strict=True)])) for step in steps]
        found = []
        for n, (now, active) in enumerate(totals(trials)):
            left = [x - t for x, t in zip(now, goal, strict=True)]
            found.append((misfit(left), n, left, active))
        after, n, left, active = min(found)
        gain = misfit(miss) - after
        if gain <= 0:
            break
        slow = gain < 1e-3 * misfit(miss)
        rate, miss, matrix = trials[n], left, active
        if slow:
            break
    return members.withColumn("rate", rate)


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, stay: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(doc_id, row_key, copies, n_tokens, p_<domain>..., rate)`` for ``docs(doc_id, text, ...)``.

    Rows with the same id and text stand together, ``copies`` says how many. A null or empty text has no
    tokens and its domains' priors; it takes the rate of its posteriors. Extra columns are not read. An empty table gives an empty result.
    """
    members = stored(posteriors(docs, fit(docs, labels)), "domain-posteriors")
    return rates(members, targets, stay)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, stay: tuple[str, ...] = ("clean", "low")) -> DataFrame:
    """``docs`` with each row as often as its rate says; the fraction is settled by a hash of id and text.

    Rows whose likeliest domain is one of ``stay`` are kept once at least: the solver holds their rates at 1
    or more, so that the totals still meet the targets as far as the other rows allow.
    """
    found = document_rates(docs, labels, targets, stay)
    u = F.pmod(F.xxhash64("row_key", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    counts = stored(found.select("row_key", F.col("doc_id").alias("mixed_id"), times.cast("int").alias("times")).where("times > 0"), "mix-counts")
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"))
    at = (keyed.row_key == counts.row_key) & keyed["doc.doc_id"].eqNullSafe(counts.mixed_id)
    many = keyed.join(broadcast_if_small(counts, BROADCAST_ROWS), at)
    return many.select("doc", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("doc.*")
