import math
import random
from collections import Counter

import pytest

from flowquarry.llm import catalog, embeddings
from tests.llm import rows as R

SCHEMA = "vec_id long, embedding array<float>, label int, v string, d string, cell string, n string"


def near(v, rng, spread):
    return [x + rng.gauss(0, spread) for x in v]


def vectors():
    rng = random.Random(4)
    rows, i = [], 0
    for label in (0, 1, 1, 2):
        for _ in range(6):
            center = [rng.gauss(0, 1) for _ in range(8)]
            for _ in range(rng.randrange(1, 9)):
                rows.append((i, near(center, rng, 0.14), label))
                i += 1
    rows += [(1000 + k, rows[0][1], 0) for k in range(5)]
    rows += [(1010, [x * 3 for x in rows[0][1]], 0), (1011, rows[0][1], 5), (1012, rows[0][1], None), (1013, rows[0][1], None)]
    rows += [(1020, None, 0), (1021, [], 0), (1022, [0.0] * 8, 0), (1023, [0.0] * 8, 0), (1024, [math.nan] * 8, 0), (1025, [math.inf] + [1.0] * 7, 0)]
    rows += [(1026, [None] + [1.0] * 7, 0), (1030, [1.0, 2.0], 0), (1031, [1.0, 2.0], 0), (1032, [2.0, 1.0, 0.5], 0)]
    rows += [(1, rows[1][1], rows[1][2]), (None, rows[2][1], rows[2][2])]
    return [(a, b, c, "x", "x", "x", "x") for a, b, c in rows]


def brute(rows, threshold):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and l is not None for _, v, l in rows]

    def linked(i, j):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        return good[i] and good[j] and la == lb and len(a) == len(b) and cosine(a, b) >= threshold

    n = len(rows)
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    of = R.components(range(n), linked)
    names = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            names[of[i]] = min(vec, names.get(of[i], vec))
    return Counter((rows[i][0], links[i], names.get(of[i]), rows[i][0] == names.get(of[i])) for i in range(n))


@pytest.mark.parametrize(("block", "threshold"), [(1024, 0.93), (4, 0.93), (16, 0.8)])
def test_equals_brute_force(spark, block, threshold):
    import numpy as np

    rows = vectors()
    found = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), threshold, block_rows=block).collect()
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l, *_ in rows]
    assert Counter(tuple(r) for r in found) == brute(as_float, threshold)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(tuple(r) for r in catalog.op7_embedding_near_dedup(spark, sf).collect()) == brute(rows, 0.93)


def test_cells(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.05, (40, 3)) for c in np.eye(3)])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centers = embeddings.spherical_k_means(points, 3, seed=3)
    assert np.allclose(np.linalg.norm(centers, axis=1), 1)
    assert (points @ centers.T).max(axis=1).min() > 0.5


def test_parts_of_a_cell_hold_vectors_of_like_direction():
    import numpy as np

    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.02, (200, 16)) for c in rng.normal(0, 1, (12, 16)) * 0.05 + 1])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centers, ways = embeddings.fit_cells(points, 1)
    cell, way = embeddings.parts_of(points, centers, ways)
    assert set(cell) == {0} and len(set(way)) > 4

    def radius(rows):
        center = rows.sum(axis=0) / np.linalg.norm(rows.sum(axis=0))
        return np.arccos(np.clip(rows @ center, -1, 1)).max()

    assert np.mean([radius(points[way == w]) for w in set(way)]) < 0.8 * radius(points)


def test_the_query_uses_cells(spark, sf, monkeypatch):
    seen = []
    fit = embeddings.fit_cells
    monkeypatch.setattr(embeddings, "fit_cells", lambda v, n, *a: seen.append(n) or fit(v, n, *a))
    catalog.op7_embedding_near_dedup(spark, sf)
    assert seen[0] >= embeddings.LEAST_CELLS


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extreme_components_lose_no_link(spark):
    """Squares too large or too small for a double, beside plain vectors of the same label."""
    rows = [(1, [1e200] * 8, 0), (2, [1e200] * 7 + [1.01e200], 0), (3, [1e308] * 8, 0), (4, [1e-200] * 8, 0), (5, [2e-200] * 8, 0)]
    rows += [(6, [1.0] * 8, 0), (7, [2.0] * 8, 0), (8, [5e-324] * 8, 0), (9, [1.0, -1.0] * 4, 0), (10, [1e200, -1e200] * 4, 0)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (7, 1) for i in range(1, 9)} | {9: (1, 9), 10: (1, 9)}


def test_blocks_travel_once_for_each_tile_they_meet(spark, monkeypatch):
    """Not once for each block that theirs meets, which grows with the square of the vectors."""
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 2) for i in range(240)]
    rows += [(1000 + i, near(v, rng, 0.1), label) for i, v, label in rows[::3]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    kept, store = {}, embeddings.stored
    monkeypatch.setattr(embeddings, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    for tile_bytes in (1 << 20, 1500):
        kept.clear()
        found = embeddings.near_duplicates(table, 0.93, block_rows=4, tile_bytes=tile_bytes).collect()
        assert Counter(tuple(r) for r in found) == brute(rows, 0.93)
        blocks, sent = kept["vector-blocks"].count(), kept["sent-blocks"]
        assert blocks > 40 and sent.select("block").distinct().count() == blocks
        assert sent.count() == blocks if tile_bytes > 1500 else blocks < sent.count() < kept["block-pairs"].count()


def test_vectors_are_packed_without_loss():
    import numpy as np

    for rows, size in ((np.array([[0.1, 0.2]], "f4").astype("f8"), 4), (np.array([[0.1, 0.2]]), 8), (np.array([[1e200, 5e-324]]), 8)):
        data = embeddings.packed(rows)
        assert len(data) == 2 * size and (embeddings.unpacked(data, 1, 2) == embeddings.unit(rows)).all()
