import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import mixing
from tests.llm import rows as R

GOOD, LOW, BAD = "music harbor letter candle".split(), "click here buy now".split(), "ugly vile nasty awful".split()
LABELS = "doc_id long, quality int, toxic int, word string, copies string"


def corpus(n=240):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = (GOOD, GOOD, LOW, BAD)[i % 4]
        docs.append((i, " ".join(rng.choice(words + ["the", "of"]) for _ in range(rng.randrange(5, 60)))))
        if i % 3 == 0:
            labels.append((i, int(words is GOOD), int(words is BAD), "x", "x"))
    return docs + R.hard_documents()[20:], labels + [(None, 1, 0, "x", "x"), (3, None, None, "x", "x"), (6, 1, 1, "x", "x"), (99_999, 1, 0, "x", "x")]


def brute_posteriors(docs, labels, evidence=60.0, least=4):
    by_id = {}
    for i, q, t, *_ in labels:
        if i is not None:
            old = by_id.get(i, (None, None))
            by_id[i] = tuple(min([x for x in (a, b) if x is not None], default=None) if k == 0 else max([x for x in (a, b) if x is not None], default=None) for k, (a, b) in enumerate(zip(old, (q, t), strict=True)))
    domain = {i: "toxic" if t == 1 else "low" if q == 0 else "clean" if q == 1 else None for i, (q, t) in by_id.items()}
    known = {i: d for i, d in domain.items() if d}

    def words(text):
        return [w for w in re.split(r"\s+", re.sub(r"([^\w\s]{2,})", r" \1 ", (text or "").lower())) if w]

    counts = {d: Counter() for d in mixing.DOMAINS}
    for i, t in docs:
        if i in known:
            counts[known[i]].update(words(t))
    total = sum(counts.values(), Counter())
    vocabulary = {w: n for w, n in total.items() if n >= least}
    size, all_n = len(vocabulary) + 1, sum(vocabulary.values())
    sums = {d: sum(n for w, n in c.items() if w in vocabulary) for d, c in counts.items()}
    out = {}
    for i, t in docs:
        n = len((t or "").split())
        share = min(1.0, evidence / max(n, 1))
        score = {}
        for d in mixing.DOMAINS:
            s = sum(
                math.log((counts[d][w] + 0.5) / (sums[d] + 0.5 * size)) - math.log((vocabulary[w] + 1) / (all_n + size))
                for w in words(t)
                if w in vocabulary
            )
            score[d] = math.log((sum(x == d for x in known.values()) + 1) / (len(known) + 3)) + s * share
        top = max(score.values())
        odds = {d: math.exp(s - top) for d, s in score.items()}
        out[i, t] = {d: o / sum(odds.values()) for d, o in odds.items()}
    return out


def test_posteriors_equal_brute_force(spark):
    docs, labels = corpus()
    df = R.frame(spark, docs)
    found = mixing.posteriors(df, mixing.fit(df, spark.createDataFrame(labels, LABELS))).collect()
    wanted, times = brute_posteriors(docs, labels), Counter(docs)
    key = {}
    for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect():
        key[r.k] = (r.doc_id, r.text)
    assert sorted(map(str, (key[r.row_key] for r in found))) == sorted(map(str, times))
    for r in found:
        assert r.copies == times[key[r.row_key]]
        assert r.n_tokens == len((key[r.row_key][1] or "").split())
        for d in mixing.DOMAINS:
            assert r[f"p_{d}"] == pytest.approx(wanted[key[r.row_key]][d], abs=1e-9)


def test_rates_meet_reachable_targets(spark):
    docs, labels = corpus()
    targets = {"toxic": 0.5, "low": 1.0, "clean": 1.1}
    rows = mixing.document_rates(R.frame(spark, docs), spark.createDataFrame(labels, LABELS), targets).toPandas()
    weight = rows["copies"] * rows["n_tokens"]
    assert (rows["rate"] >= 0).all()
    for d, t in targets.items():
        goal = t * (weight * rows[f"p_{d}"]).sum()
        assert (weight * rows[f"p_{d}"] * rows["rate"]).sum() == pytest.approx(goal, rel=1e-3)


def test_unreachable_targets_come_as_near_as_projected_gradients_get(spark):
    """Each row is half toxic: nothing but rate 0 lowers toxic tokens, and that loses the clean ones."""
    rows = [(i, i, 1, 10, 0.5, 0.0, 0.5) for i in range(20)]
    members = spark.createDataFrame(rows, "doc_id long, row_key long, copies long, n_tokens long, p_toxic double, p_low double, p_clean double")
    rate = [r.rate for r in mixing.rates(members, {"toxic": 0.0, "low": 1.0, "clean": 1.0}).collect()]
    assert max(rate) - min(rate) < 1e-9
    assert rate[0] == pytest.approx(0.5, abs=1e-6)


def brute_rates(members, targets, least):
    """The same least squares by many plain steps of projected gradients, with the bounds of each row."""
    p = np.array([[m[4], m[5], m[6]] for m in members])
    weight = np.array([m[2] * m[3] for m in members], float)
    goal = np.array([targets[d] for d in mixing.DOMAINS]) * (p * weight[:, None]).sum(axis=0)
    whole = np.linalg.pinv((p * weight[:, None]).T @ p)
    rate = np.ones(len(p))
    for _ in range(20_000):
        rate = np.maximum(least, rate - p @ (whole @ ((p * weight[:, None] * rate[:, None]).sum(axis=0) - goal)))
    miss = lambda totals: totals - goal
    return (p * weight[:, None] * rate[:, None]).sum(axis=0), lambda totals: float(miss(totals) @ whole @ miss(totals))


@pytest.mark.parametrize("stay", [(), ("clean", "low"), ("toxic",)])
@pytest.mark.parametrize("targets", [{"toxic": 0.25, "low": 1.0, "clean": 1.2}, {"toxic": 0.0, "low": 0.1, "clean": 0.3}])
def test_rates_are_least_squares_within_their_bounds(spark, stay, targets):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.6, 1.0], size=150)
    members = [(i, i, int(rng.integers(1, 4)), int(rng.integers(0, 300)), *map(float, p[i])) for i in range(150)]
    df = spark.createDataFrame(members, "doc_id long, row_key long, copies long, n_tokens long, p_toxic double, p_low double, p_clean double")
    found = mixing.rates(df, targets, stay).orderBy("doc_id").collect()
    least = np.array([1.0 if list(mixing.DOMAINS)[int(np.argmax(x))] in stay else 0.0 for x in p])
    rate = np.array([r.rate for r in found])
    assert (rate >= least).all()
    totals, misfit = brute_rates(members, targets, least)
    got = np.array([sum(r.copies * r.n_tokens * r[f"p_{d}"] * r.rate for r in found) for d in mixing.DOMAINS])
    # it ends where a round gains little, so it may stop a little short of the least where targets are out of reach
    assert misfit(got) <= 1.2 * misfit(totals) + 1e-3 * abs(totals).max()


def test_small_systems():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.normal(size=(3, 3)), rng.normal(size=3)
        a = a @ a.T
        assert np.allclose(mixing.solve(a.tolist(), b.tolist()), np.linalg.solve(a, b))
    assert mixing.solve([[2.0, 0.0], [0.0, 0.0]], [4.0, 5.0]) == [2.0, 0.0]
    assert np.allclose(mixing.solve([[1.0, 1.0], [1.0, 1.0]], [1.0, 3.0]), [1.0, 1.0])


def test_mix_repeats_and_drops_by_the_rates(spark):
    docs, labels = corpus()
    df, known = R.frame(spark, docs), spark.createDataFrame(labels, LABELS)
    out = mixing.mix(df, known)
    assert out.columns == df.columns
    rate = {}
    keys = {r.k: (r.doc_id, r.text) for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()}
    rows = mixing.document_rates(df, known, stay=("clean", "low")).collect()
    likely = {}
    for r in rows:
        rate[keys[r.row_key]] = r.rate
        likely[keys[r.row_key]] = max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"])
    got, had = Counter((r.doc_id, r.text) for r in out.collect()), Counter(docs)
    for k, n in had.items():
        each = got[k] / n
        least = 1 if likely[k] in ("clean", "low") else 0
        assert max(least, math.floor(rate[k])) <= each <= max(least, math.ceil(rate[k])), (k, rate[k])
    assert any(got[k] == 0 for k in had if likely[k] == "toxic")


def test_plans_hold_no_python(spark, sf):
    from flowquarry.llm import catalog

    plan = catalog.op8_mixing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert mixing.mix(R.empty(spark), none).count() == 0
    docs = R.hard_documents()
    rows = mixing.document_rates(R.frame(spark, docs), none).collect()
    assert sum(r.copies for r in rows) == len(docs)
    assert mixing.mix(R.frame(spark, docs), none).count() >= 0
