import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import catalog, lm_scoring
from tests.llm import rows as R

SF = "/root/testdata/sf0.01"


def brute_scores(docs, targets, counted=True):
    """Both models from plain dictionaries over the words themselves, anew for each text without that text."""
    texts = [["<s>", *(t or "").lower().split(), "</s>"] if (t or "").split() else [] for _, t in docs]
    size = len({w for t in texts for w in t})
    sides = []
    for side in ("background", "target"):
        uni, before, grams = Counter(), Counter(), Counter()
        for (i, _), t in zip(docs, texts, strict=True):
            if side == "background" or (i is not None and i in targets):
                uni.update(t[1:])
                before.update(t[:-1])
                grams.update(zip(t, t[1:], strict=False))
        sides.append((uni, before, grams))
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        found = []
        for side, (uni, before, grams) in enumerate(sides):
            out_of = counted and (side == 0 or (i is not None and i in targets))
            own = [Counter(t[1:]), Counter(t[:-1]), Counter(zip(t, t[1:], strict=False))] if out_of else [Counter()] * 3
            total = sum(uni.values()) - sum(own[0].values())
            loss = 0.0
            for a, b in zip(t, t[1:], strict=False):
                share = (uni[b] - own[0][b] + 1) / (total + size)
                loss -= math.log((grams[a, b] - own[2][a, b] + lm_scoring.BACKOFF * share) / (before[a] - own[1][a] + lm_scoring.BACKOFF))
            found.append(loss / (len(t) - 1) if t else None)
        out.append((i, max(len(t) - 2, 0), *found))
    return out


def marked(spark, docs, targets, counted=True):
    target = F.coalesce(F.col("doc_id").isin(targets), F.lit(False))
    return R.frame(spark, docs, extra=False).withColumns({"target": target, "counted": F.lit(counted)})


@pytest.mark.parametrize("hot", [0, 9, 40, lm_scoring.HOT])
def test_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    docs, targets = R.hard_documents(), {1, 7, 120, 200, 9999}
    df = marked(spark, docs, targets)
    found = lm_scoring.score(df, lm_scoring.fit(df)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(brute_scores(docs, targets), key=key), strict=True):
        assert got[:2] == want[:2]
        if want[1]:
            assert got[2:4] == pytest.approx(want[2:4], rel=1e-6)
            assert got[4] == pytest.approx(got[3] - got[2])
        else:
            assert got[2:] == (None, None, None)


@pytest.mark.parametrize("hot", [0, 50, lm_scoring.HOT])
def test_no_word_or_bigram_is_left_out(spark, monkeypatch, hot):
    """60,000 words once each, and some that are frequent."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    docs = [(k, " ".join(f"w{k}x{i}" for i in range(3000))) for k in range(20)] + [(50, "a b a b a c"), (51, "a b a b"), (52, None)]
    df = marked(spark, docs, {1, 50})
    models = lm_scoring.fit(df)
    assert models.words.count() == 60_003 + 2
    found = {r.doc_id: r for r in lm_scoring.score(df, models).collect()}
    for i, n, background, target in brute_scores(docs, {1, 50}):
        assert found[i].n_words == n
        if n:
            assert (found[i].ce_background, found[i].ce_target) == pytest.approx((background, target), rel=1e-6)


def test_probabilities_add_up_to_one(spark):
    """One text for each word that may follow, and one that ends: their last steps have all of the probability."""
    docs = [(1, "a b a b a c"), (2, "a b")]
    df = marked(spark, docs, {2})
    models = lm_scoring.fit(df)
    fresh = [(10, "a"), (11, "a a"), (12, "a b"), (13, "a c"), (14, "a unknown")]
    both = df.union(marked(spark, fresh, set(), counted=False))
    found = {r.doc_id - 10: r for r in lm_scoring.score(both, models).collect() if r.doc_id >= 10}
    fresh = [(i - 10, t) for i, t in fresh]
    for side in ("ce_background", "ce_target"):
        loss = {i: found[i][side] * (len(t.split()) + 1) for i, t in fresh}
        words = Counter("a b a b a c a b".split() if side == "ce_background" else ["a", "b"])
        ends = 2 if side == "ce_background" else 1
        grams = Counter({("a", "b"): 3, ("b", "a"): 2, ("a", "c"): 1, ("b", "/"): 1, ("c", "/"): 1} if side == "ce_background" else {("a", "b"): 1, ("b", "/"): 1})
        p = lambda a, b: (grams[a, b] + 20 * ((ends if b == "/" else words[b]) + 1) / (sum(words.values()) + ends + 5)) / (words[a] + 20)  # noqa: B023, E731
        start = loss[0] + math.log(p("a", "/"))
        follows = {i: math.exp(start - loss[i]) / p(w, "/") for i, w in ((1, "a"), (2, "b"), (3, "c"), (4, "unknown"))}
        assert sum(follows.values()) + p("a", "/") == pytest.approx(1)


def test_likeness_to_the_target_lowers_the_score(spark):
    near = [(i, "alpha beta gamma delta " * 5) for i in range(10)]
    far = [(100 + i, "north south east west " * 5) for i in range(10)]
    ids = spark.createDataFrame([(i,) for i in range(5)] + [(None,), (3,)], "doc_id long")
    score = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(R.frame(spark, near + far), ids).collect()}
    assert max(score[i] for i, _ in near) < min(score[i] for i, _ in far)


def test_a_document_does_not_vouch_for_itself(spark):
    docs = [(i, R.sentence(i, 40)) for i in range(30)] + [(100, "quite other words " + R.sentence(7, 3)), (101, "never heard before these words " + R.sentence(8, 3))]
    ids = spark.createDataFrame([(100,)], "doc_id long")
    score = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(R.frame(spark, docs), ids).collect()}
    assert score[100] == pytest.approx(score[101], abs=1.5)


def test_few_tokens_held_at_a_time_give_the_same_counts(monkeypatch):
    def counted(held):
        monkeypatch.setattr(lm_scoring, "HELD", held)
        total = Counter()
        batch = pa.RecordBatch.from_pydict({"text": ["a b c a", None, "d e f g a", "a b"], "target": [True, True, False, None]})
        for found in lm_scoring._count(None)(iter([batch])):
            for row in found.to_pylist():
                total[row["gram"], row["key"], "all"] += row["background"]
                total[row["gram"], row["key"], "target"] += row["target"]
        return total

    assert counted(3) == counted(1000)
    assert sum(n for (gram, _, side), n in counted(3).items() if gram and side == "all") == 14


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.cross_entropy_difference(R.empty(spark), none).count() == 0
    assert lm_scoring.cross_entropy_difference(R.frame(spark, R.hard_documents()), none).count() == len(R.hard_documents())


def test_query_tells_labelled_quality_apart(spark):
    found = catalog.op4_lm_scoring(spark, SF).toPandas()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = found.merge(labels, on="doc_id").dropna(subset=["score"])
    assert both[both["quality"] == 1]["score"].median() < both[both["quality"] == 0]["score"].median()


def test_chunks_and_buckets_change_no_score(spark, monkeypatch):
    texts = [R.sentence(k % 9, 40 + k) + " " + R.sentence(50, 12) for k in range(40)]
    docs = R.frame(spark, [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])]).repartition(3).cache()
    good = docs.where("doc_id % 3 = 0").select("doc_id")
    # no bigram is frequent, so all meet in buckets
    monkeypatch.setattr(lm_scoring, "SAMPLE_ROWS", 0)
    score = lambda: {r.doc_id: tuple(r) for r in lm_scoring.cross_entropy_difference(docs, good).collect()}
    one = score()
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(lm_scoring, "CHUNK", 300)
    made = []
    near_rows = lm_scoring._near_rows
    monkeypatch.setattr(lm_scoring, "_near_rows", lambda ids, shared, buckets: made.append(near_rows(ids, shared, buckets)) or made[-1])
    assert score() == one
    met = made[0].groupBy("bucket").count().count()
    assert met > 5
    # a row for each text, and one for each chunk and bucket at most, however often texts meet
    texts_in, bundles = made[0].where("keys is null"), made[0].where("keys is not null")
    assert texts_in.count() == 41
    assert bundles.count() <= texts_in.select("chunk").distinct().count() * met
