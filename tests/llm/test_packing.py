from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowquarry.llm import packing
from tests.llm import rows as R


def brute_pack(lengths, sizes):
    """Best fit by looking at every open bin."""
    largest = max(sizes)
    pieces = []
    for i, n in enumerate(lengths):
        k = 0
        while n > 0:
            pieces.append((min(n, largest), i, k))
            n, k = n - largest, k + 1
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    price = min(packing.cost(s) / s for s in sizes)
    bins, out = [], []
    for at, (n, i, k) in enumerate(pieces):
        ahead = sum(m for m, _, _ in pieces[at + 1 :])
        fits = [(size - held, b) for b, (size, held) in enumerate(bins) if size - held >= n]
        if fits:
            b = min(fits)[1]
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: (packing.cost(s) - price * min(s - n, ahead), s))
            b = len(bins)
            bins.append((size, 0))
        size, held = bins[b]
        out.append((i, k, n, b, held))
        bins[b] = (size, held + n)
    return [(i, k, n, b, min(s for s in sizes if s >= bins[b][1]), start) for i, k, n, b, start in out]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=40), st.sampled_from([(8, 16, 32), (5, 7, 40), (32,), (16, 8)]))
def test_equals_brute_force(lengths, sizes):
    assert packing.pack(lengths, sizes) == brute_pack(lengths, sizes)


def test_bins_shrink_to_their_contents():
    placed = packing.pack([500, 400, 90], (128, 512, 1024))
    held = Counter()
    for _, _, n, b, _, _ in placed:
        held[b] += n
    for _, _, _, b, size, _ in placed:
        assert size == min(s for s in (128, 512, 1024) if s >= held[b])


@pytest.mark.parametrize("shard_docs", [50_000, 7])
def test_all_tokens_are_placed_once(spark, shard_docs):
    docs = R.hard_documents()
    rows = packing.best_fit(R.frame(spark, docs), shard_docs=shard_docs).collect()
    tokens = Counter()
    for i, t in docs:
        tokens[i] += len((t or "").split())
    placed = Counter({i: 0 for i, _ in docs})
    bins = defaultdict(list)
    for r in rows:
        placed[r.doc_id] += r.n_tokens
        if r.bin_id is None:
            assert (r.n_tokens, r.piece, r.bin_size, r.start) == (0, 0, None, None)
        else:
            bins[r.bin_id, r.bin_size].append((r.start, r.n_tokens))
    assert placed == tokens
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), parts in bins.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert size == min(s for s in packing.SIZES if s >= at)
    empty = [i for i, t in docs if not (t or "").split()]
    assert Counter(r.doc_id for r in rows if r.bin_id is None) == Counter(empty)


def test_one_shard_equals_brute_force(spark):
    docs = [(i, t) for i, t in R.hard_documents() if i is not None]
    rows = packing.best_fit(R.frame(spark, docs)).collect()
    lengths = sorted(((-len((t or "").split()), i) for i, t in docs))
    wanted = brute_pack([-n for n, _ in lengths], packing.SIZES)
    got = Counter((r.doc_id, r.piece, r.n_tokens, r.bin_id, r.bin_size, r.start) for r in rows if r.bin_id is not None)
    assert got == Counter((lengths[i][1], k, n, b, size, start) for i, k, n, b, size, start in wanted)


def test_empty_table(spark):
    assert packing.best_fit(R.empty(spark)).count() == 0


def test_bins_can_be_filled(spark):
    docs = [(i, t) for i, t in R.hard_documents()] + [(7, R.sentence(7, 37))]
    df = R.frame(spark, docs)
    placed = packing.best_fit(df, sizes=(16, 64, 256))
    filled = packing.with_text(df, placed).collect()
    assert len(filled) == placed.count()
    texts = defaultdict(set)
    for i, t in docs:
        texts[i].add(tuple((t or "").split()))
    for r in filled:
        words = tuple(r.text.split())
        assert len(words) == r.n_tokens
        assert any(t[r.doc_start : r.doc_start + r.n_tokens] == words for t in texts[r.doc_id])
    bins = packing.sequences(packing.with_text(df, placed)).collect()
    assert sum(b.n_tokens for b in bins) == sum(len((t or "").split()) for _, t in docs)
    for b in bins:
        words = b.text.split()
        assert len(words) == b.n_tokens <= b.bin_size
        for i, start, end in zip(b.doc_ids, b.starts, [*b.starts[1:], b.n_tokens], strict=True):
            assert any(" ".join(words[start:end]) in " ".join(t) for t in texts[i])
