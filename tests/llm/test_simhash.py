import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from flowquarry.llm import simhash
from tests.llm import rows as R


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def unsigned(x):
    return x & (1 << 64) - 1


@pytest.mark.parametrize("text", [None, "", " \t", "One", "One two", "a b c", "A  b\x0bc d e f", "é " * 50, "x y z " * 2000])
def test_fingerprint_of_one_text(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = R.sentence(5, 5000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 97)
    assert simhash.fingerprint(text) == whole


def test_components_equal_brute_force(spark):
    docs = R.hard_documents()
    found = simhash.near_duplicates(R.frame(spark, docs)).collect()
    prints = {t: brute_fingerprint(t) for _, t in docs}
    assert Counter((r.doc_id, unsigned(r.fp)) for r in found) == Counter((i, prints[t]) for i, t in docs)
    groups = R.components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i, t in docs:
        if i is not None:
            first[groups[prints[t]]] = min(i, first.get(groups[prints[t]], i))
    assert {(r.doc_id, unsigned(r.fp)): r.component_id for r in found} == {(i, prints[t]): first.get(groups[prints[t]]) for i, t in docs}


@pytest.mark.parametrize(("distance", "small"), [(2, 48), (2, 2), (1, 48), (1, 2), (0, 48)])
def test_links_keep_components_whole(spark, distance, small):
    """Fingerprints in families by one to three bits, so that chains run through missing neighbours; with and without large buckets."""
    rng = random.Random(distance + small)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:12]:
        for _ in range(12):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3]))))
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    pairs = [(unsigned(r.a), unsigned(r.b)) for r in simhash.links(fps, distance, small).collect()]
    linked = {frozenset(p) for p in pairs}
    wanted = R.components(values, lambda a, b: (a ^ b).bit_count() <= distance)
    got = R.components(values, lambda a, b: frozenset((a, b)) in linked)
    assert got == wanted


def test_pivot_coordinates_bound_the_distance(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        pairs.append((simhash.signed(a), simhash.signed(a ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 30))))))
    df = spark.createDataFrame(pairs, "a long, b long")
    gap = simhash.coordinate_gap(F.col("a"), F.col("b"))
    assert df.where(gap > simhash.distance(F.col("a"), F.col("b"))).count() == 0


def test_keep_one_of_each_group(spark):
    docs = R.hard_documents()
    df = R.frame(spark, docs)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = R.components({brute_fingerprint(t) for _, t in docs}, lambda a, b: (a ^ b).bit_count() <= 2)
    rows = kept.select("doc_id", "text").collect()
    of = [groups[brute_fingerprint(r.text)] for r in rows]
    assert sorted(of) == sorted(set(groups.values()))
    for r, g in zip(rows, of, strict=True):
        ids = [i for i, t in docs if groups[brute_fingerprint(t)] == g and i is not None]
        assert r.doc_id == (min(ids) if ids else None)


def test_empty_table(spark):
    assert simhash.near_duplicates(R.empty(spark)).count() == 0
    assert simhash.keep_one(R.empty(spark)).count() == 0


def test_hex():
    assert simhash.signed((1 << 64) - 1) == -1


def test_hex_column(spark):
    row = spark.createDataFrame([(-1,), (255,)], "fp long").select(simhash.as_hex(F.col("fp")).alias("h")).collect()
    assert [r.h for r in row] == ["f" * 16, "00000000000000ff"]
