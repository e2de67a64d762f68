import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from flowquarry.llm import catalog
from flowquarry.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, distance string"


def brute(rows, rounds=2, entries=64, parts=16):
    kept = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][1]) // parts
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for _, x, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: kept[i][0])[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def assigned():
        off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        return [[min((off(c[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = assigned()
    errors = [sum(d for d, _ in f) for f in found]
    of_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        of_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    codes = ["".join(f"{k:02x}" for _, k in f) for f in found]
    return Counter((i, code, e, of_label[label], digest) for (i, _, label), code, e in zip(kept, codes, errors, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def vectors(seed, n, width=32, levels=40):
    rng = random.Random(seed)
    return [(i, [rng.randrange(-levels, levels) / 64 for _ in range(width)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "levels"), [(300, 40), (300, 2), (20, 40)])
def test_equals_brute_force(spark, n, levels):
    rows = vectors(1, n, levels=levels)
    rows += [(1000, None, 0), (1001, [math.nan] * 32, 0), (1002, [None] * 32, 1), (1003, [math.inf] * 32, 1)]
    found = Counter(tuple(r) for r in V.codes(frame(spark, [*rows, (2000, [1.0], 0), (2001, [], 0)])).collect())
    assert found == brute(rows)


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_other_rounds(spark, rounds):
    rows = vectors(2, 150, 16)
    assert Counter(tuple(r) for r in V.codes(frame(spark, rows), rounds=rounds, entries=8).collect()) == brute(rows, rounds, 8)


@pytest.mark.parametrize("seed", range(30))
def test_active_entries_equal_a_whole_scan(seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-3, 4, (200, 2)), rng.integers(-3, 4, (12, 2))
    code, distance = V.nearest(x, book, np.arange(12))
    moved = rng.random(12) < 0.3
    after = np.where(moved[:, None], rng.integers(-3, 4, (12, 2)), book)
    expected = V.nearest(x, after, np.arange(12))
    V.reassign(x, after, code, distance, moved)
    assert (code == expected[0]).all()
    assert (distance == expected[1]).all()


def test_only_moved_entries_are_compared(monkeypatch):
    rng = np.random.default_rng(1)
    x, book = rng.integers(-50, 50, (100, 2)), rng.integers(-50, 50, (10, 2))
    code, distance = V.nearest(x, book, np.arange(10))
    looked, whole = [], V.nearest
    monkeypatch.setattr(V, "nearest", lambda x, book, among: looked.append((len(x), len(among))) or whole(x, book, among))
    moved = np.arange(10) == 3
    V.reassign(x, book, code, distance, moved)
    assert looked == [((code != 3).sum(), 1), ((code == 3).sum(), 10)]
    looked.clear()
    V.reassign(x, book, code, distance, np.zeros(10, bool))
    assert looked == []


def test_repeated_rows_null_ids_and_lengths(spark):
    rows = [*vectors(3, 80, 20), *vectors(3, 5, 20)]
    found = V.codes(frame(spark, [*rows, (None, rows[0][1], 7)])).collect()
    assert len(found) == 86
    assert len({tuple(r) for r in found if r.vec_id == 3}) == 1
    assert [r.code for r in found if r.vec_id is None] == [r.code for r in found if r.vec_id == 0][:1]
    assert [r.label_error for r in found if r.vec_id is None] == [r.error for r in found if r.vec_id is None]


def test_extreme_components(spark):
    rows = [(i, [1e300 * (-1) ** i] * 16 + [float(i)] * 16, 0) for i in range(80)]
    found = V.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(found) == 80
    assert all(r.error >= 0 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)]])
def test_nothing_to_code(spark, rows):
    assert V.codes(frame(spark, rows)).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in catalog.op13_vector_codes(spark, sf).collect()) == brute(rows)
