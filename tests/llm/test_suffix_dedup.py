import hashlib
import random
from collections import Counter

import pytest

from flowquarry.llm import catalog
from flowquarry.llm import suffix_dedup as S
from tests.llm import rows as R


def brute(rows):
    """One row per document, by counting every window as it is."""
    data = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
    seen = Counter(b[i : i + S.WINDOW] for b in data for i in range(len(b) - S.WINDOW + 1))
    out = []
    for (doc, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - S.WINDOW + 1):
            if seen[b[i : i + S.WINDOW]] > 1:
                gone[i : i + S.WINDOW] = b"\1" * S.WINDOW
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def letters(seed, n, alphabet="abcdefgh "):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


def planted():
    """Passages around the window's length, at starts and ends of texts, overlapping, periodic, in wide characters."""
    passage, other, wide = letters(1, 900), letters(2, 400), letters(3, 300, "äöü漢")
    rows = [(i, letters(10 + i, 50 * i) + passage[:n] + letters(50 + i, 30)) for i, n in enumerate((398, 399, 400, 401, 640, 900))]
    rows += [(20, passage[250:] + letters(70, 900)), (21, letters(71, 700) + passage[:420]), (22, other), (23, letters(72, 10) + other)]
    rows += [(24, letters(73, 600) + other[:399]), (25, wide + letters(74, 20)), (26, letters(75, 20) + wide), (27, letters(76, 450))]
    rows += [(30, "a" * 401), (31, "a" * 5000 + letters(77, 500)), (32, "b" * 400), (33, "xyz" * 400 + letters(78, 450)), (34, ("line of text\n" * 60) + letters(79, 450))]
    edited = letters(80, 3000)
    rows += [(40 + k, edited[: 500 * k] + "#" + edited[500 * k :]) for k in range(6)]
    rows += [(50, letters(81, 800) + "|" + letters(81, 800)), (51, passage + passage), (52, passage[:399] + passage[:399])]
    return rows


def digests(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.mark.parametrize("chunk", [S.CHUNK, 1000])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = planted()
    assert digests(S.repeated_spans(R.frame(spark, rows))) == brute(rows)


def test_chunks_do_not_matter():
    texts = [letters(1, 5000), None, "", letters(2, 399), letters(3, 400), letters(1, 5000)]
    whole = S.anchor_rows(texts)
    starts = lambda found: Counter((t, p) for t, a, b in zip(found[0], found[3], found[4], strict=True) for p in range(a, b + 1))
    size, S.CHUNK = S.CHUNK, 777
    try:
        pieces = S.anchor_rows(texts)
    finally:
        S.CHUNK = size
    assert starts(whole) == starts(pieces)
    assert max(starts(whole).values()) == 1
    assert len(starts(whole)) == 2 * 4601 + 1


def test_hard_documents(spark):
    rows = R.hard_documents()
    assert digests(S.repeated_spans(R.frame(spark, rows))) == brute(rows)


def test_rows_repeated_whole_and_null_ids(spark):
    text = letters(5, 500)
    rows = [(1, text), (1, text), (None, letters(6, 450)), (None, letters(6, 450)), (None, letters(7, 450)), (2, letters(8, 450) + text[:399])]
    found = S.repeated_spans(R.frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 0), (0, 450), (0, 450), (1, 500), (1, 500), (2, 0)]


def test_a_passage_in_very_many_texts(spark):
    passage = letters(9, 450)
    rows = [(i, letters(100 + i, 60) + passage + letters(900 + i, 60)) for i in range(400)]
    found = S.repeated_spans(R.frame(spark, rows))
    assert all(r.spans[0].start <= 60 and r.spans[0].end >= 510 for r in found.collect())
    assert digests(found) == brute(rows)


def test_empty_table(spark):
    assert S.repeated_spans(R.empty(spark)).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert digests(catalog.op11_suffix_array_dedup(spark, sf)) == brute(rows)
