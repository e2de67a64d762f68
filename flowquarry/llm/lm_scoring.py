"""Cross-entropy difference between a target and a background bigram model over one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import Codes, broadcast_if_small, small_batches, stored

#: How many occurrences the unigram estimate counts for beside a bigram's own.
BACKOFF = 20.0
#: Tokens that a task holds before it adds them up, and before it scores them.
HELD = 1_000_000
SCORED = 250_000
#: Tokens and texts of a chunk, whose bigrams travel together, and bytes of text whose bigrams meet in one bucket, about.
CHUNK, CHUNK_TEXTS = 2_000_000, 50_000
BUCKET_BYTES = 16_000_000
#: The most frequent words, and bigrams, up to so many each, are scored where the texts are; all others meet in shuffles.
HOT = 400_000
#: Rows in which frequent bigrams are looked for, about. It bears on speed alone: what they count is counted over all rows.
SAMPLE_ROWS = 10_000
IDS_ROWS = 2_000_000
#: Codes of what stands before a text's first word and after its last one.
START, END = -1, -2
#: Odd, so that pairs of codes that differ in one word have different keys.
PAIRING = np.uint64(0x9E3779B97F4A7C15)
#: Losses are added up as whole billionths of a nat, so sums do not depend on order.
UNIT = 1_000_000_000
SIDES = ("background", "target")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space."""
    return (text or "").lower().split()


def sequence(text: str | None, codes: Codes) -> np.ndarray:
    """START, the codes of the text's words, END; nothing for a text without words."""
    words = words_of(text)
    out = np.empty(len(words) + 2 if words else 0, np.int64)
    if words:
        out[0], out[-1] = START, END
        out[1:-1] = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word with the one before it."""
    return (before.view(np.uint64) * PAIRING + word.view(np.uint64)).view(np.int64)


Hot = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys in order, and their background and target counts


@dataclass
class Models:
    """Background and target counts of the words, as a table that grows with the corpus, and of frequent bigrams.

    Other bigrams are counted where their occurrences meet to be scored. Words, START and END are named by
    64-bit hashes and bigrams by a hash of two of those: 10^9 words bring 0.03 expected collisions, 10^11
    bigrams some hundred. A word is followed as often as it occurs, as END follows the last, so one table
    serves for words and for predecessors.
    """

    words: DataFrame  # (key, background, target)
    least: int  # words from this background count on are hot
    hot_words: Hot
    hot_grams: Hot
    totals: tuple[int, int]  # words and ENDs counted for background and target
    size: int  # entries of the vocabulary, with END and one for all unknown words


def _sums(keys: np.ndarray, marks: np.ndarray, gram: bool) -> pa.RecordBatch:
    found, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    target = np.bincount(at, weights=marks, minlength=len(found)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), gram)), pa.array(found), pa.array(n), pa.array(target)], ["gram", "key", *SIDES])


def _has(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which ``keys`` are among the ordered ``wanted``."""
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys if len(wanted) else np.zeros(len(keys), bool)


def _count(wanted: np.ndarray | None):
    """Sums over a task's texts: of all words and the ``wanted`` bigrams, or where that is None, of all bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, marks, tokens = Codes(), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, mark = np.concatenate(held), np.repeat(np.array(marks, np.float64), list(map(len, held)))
            inner = np.nonzero(ids[:-1] != END)[0]
            grams = pair_keys(ids[inner], ids[inner + 1])
            if wanted is not None:
                yield _sums(ids, mark, False)
                near = _has(grams, wanted)
                grams, inner = grams[near], inner[near]
            yield _sums(grams, mark[inner], True)

        for batch in batches:
            for text, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                held.append(sequence(text, codes))
                marks.append(bool(target))
                tokens += len(held[-1])
                if tokens >= HELD:
                    yield from out()
                    held, marks, tokens = [], [], 0
        if tokens:
            yield from out()

    return run


def _counted(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    partial = docs.select("text", "target").mapInArrow(_count(wanted), "gram boolean, key long, background long, target long")
    return partial.groupBy("gram", "key").agg(*[F.sum(s).alias(s) for s in SIDES])


def _least_hot(counts: DataFrame) -> int:
    """The least count from which on there are no more than HOT rows, or a few less: it is a step of a histogram by eighths of powers of two."""
    steps = counts.groupBy(F.floor(F.log2("background") * 8).alias("step")).agg(F.count("*").alias("rows"), F.min("background").alias("least")).collect()
    least, seen = 1 << 62, 0
    for row in sorted(steps, key=lambda r: -r["step"]):
        seen += row["rows"]
        if seen > HOT:
            break
        least = row["least"]
    return least


def _arrays(counts: DataFrame) -> Hot:
    found = counts.toArrow()
    columns = [found.column(c).to_numpy() for c in ("key", *SIDES)]
    order = np.argsort(columns[0])
    return tuple(c[order] for c in columns)


def fit(docs: DataFrame) -> Models:
    """Both models from ``docs(text, target)``: the background from every row, the target from those marked so.

    One pass counts all words and, of the bigrams that occur twice or more in a sample, the occurrences
    in all rows. Each task adds up its own before the one shuffle.
    """
    small_batches(docs.sparkSession)
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20) < min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    sample = stored(_counted(docs.where(drawn), None).where("background > 1"), "sample-bigrams")
    wanted = _arrays(sample.where(F.col("background") >= _least_hot(sample)))[0]
    counts = stored(_counted(docs, wanted), "ngram-counts")
    words, grams = (counts.where(c).select("key", *SIDES) for c in ("not gram", "gram"))
    spoken = words.agg(F.count("*").alias("size"), *[F.sum(F.when(F.col("key") != START, F.col(s))).alias(s) for s in SIDES]).first()
    least = _least_hot(words)
    hot_words = _arrays(words.where(F.col("background") >= least))
    return Models(words, least, hot_words, _arrays(grams), (spoken["background"] or 0, spoken["target"] or 0), spoken["size"])


def _find(hot: Hot, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Whether each key is hot, its place among the hot ones, and its two counts, else 0."""
    place = np.minimum(np.searchsorted(hot[0], keys), max(len(hot[0]) - 1, 0))
    known = hot[0][place] == keys if len(hot[0]) else np.zeros(len(keys), bool)
    place[~known] = 0
    counts = [np.zeros(len(keys), np.int64) for _ in SIDES]
    for n, c in zip(counts, hot[1:], strict=True):
        n[known] = c[place[known]]
    return known, place, counts


def _groups(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of each document's different keys, how often each occurs, and the group of every position."""
    order = np.argsort(keys)
    order = order[np.argsort(doc[order], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    starts = np.nonzero(new)[0]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[starts], np.diff([*starts, len(order)]), group


def _joined(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes, the text of each, and the texts' lengths. Batches are small, so short numbers name the texts, which sort fast."""
    lengths = np.array(list(map(len, sequences)))
    return np.concatenate(sequences), np.repeat(np.arange(len(sequences), dtype=np.uint16), lengths), lengths


def _packed(rows: np.ndarray) -> bytes:
    """Compressed rows of whole numbers, byte by byte of each, as the high bytes of small numbers are alike."""
    return pa.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, rows: int, kind: type, width: int = 1) -> np.ndarray:
    size = np.dtype(kind).itemsize * width
    planes = np.frombuffer(pa.decompress(data, rows * size, codec="zstd", asbytes=True), np.uint8).reshape(size, rows)
    return np.ascontiguousarray(planes.T).view(kind).reshape(rows, width)


class Scorer:
    """What a task knows of the models, and the rows it makes of its texts."""

    def __init__(self, models: Models):
        self.hot_words, self.hot_grams, self.totals, self.size = models.hot_words, models.hot_grams, models.totals, models.size

    def near(self, sequences: list[np.ndarray], marked: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's losses as far as hot words and bigrams tell them, and its other bigrams that end in a hot word: text, key, facts.

        The losses take those bigrams for unseen elsewhere. A bigram of two hot words is named by their places; beside
        another key stands the place of its word, from 1, after the times of the bigram and of the word in the text.
        """
        ids, doc, lengths = _joined(sequences)
        docs, own = len(sequences), [counted.astype(np.int64), (marked & counted).astype(np.int64)]
        first, times, group = _groups(doc, ids)
        known, place, counts = _find(self.hot_words, ids[first])
        losses = np.zeros((2, docs), np.int64)
        shares, d = [], doc[first]
        followed = known & (ids[first] != END)

        def add(side: int, rows: np.ndarray, nats: np.ndarray) -> None:
            np.add.at(losses[side], rows, np.rint(nats * UNIT).astype(np.int64))

        for side in (0, 1):
            rest = counts[side] - times * own[side][d]
            shares.append(BACKOFF * (rest + 1) / (self.totals[side] - np.maximum(lengths - 1, 0) * own[side] + self.size)[d])
            add(side, d[followed], times[followed] * np.log(rest[followed] + BACKOFF))
        at = np.nonzero(ids[:-1] != END)[0] if len(ids) else np.zeros(0, np.int64)
        pairs, d = pair_keys(ids[at], ids[at + 1]), doc[at]
        g_first, g_times, _ = _groups(d, pairs)
        word, before, d, pairs = group[at[g_first] + 1], group[at[g_first]], d[g_first], pairs[g_first]
        seen, _, g_counts = _find(self.hot_grams, pairs)
        for side in (0, 1):
            n = np.where(seen, g_counts[side] - g_times * own[side][d], 0) + shares[side][word]
            add(side, d[known[word]], -g_times[known[word]] * np.log(n[known[word]]))
        left = known[word] & ~seen
        d, word, before = d[left], word[left], before[left]
        both = known[before]
        facts = np.stack([g_times[left], times[word], np.where(both, 0, place[word] + 1)], axis=1).astype(np.uint32)
        return losses, d, np.where(both, place[before] << 32 | place[word], pairs[left]), facts

    def met(self, table: pa.Table) -> pa.Table:
        """Rows of texts as they are, and what the bigrams of one bucket that occur in other texts too change in their texts' losses."""
        texts = table.filter(pc.is_null(table["keys"])).select(list(LOSSES))
        for name in ("n_docs", "changes"):
            texts = texts.append_column(name, pa.nulls(len(texts), KINDS[MET[name]]))
        bundles = table.filter(pc.is_valid(table["keys"]))
        if not len(bundles):
            return texts
        docs = [_unpacked(data, n, np.uint32, 4) for data, n in zip(bundles["docs"].to_pylist(), bundles["n_docs"].to_pylist(), strict=True)]
        sizes = [int(d[:, 3].sum()) for d in docs]
        keys = np.concatenate([_unpacked(data, n, np.int64)[:, 0] for data, n in zip(bundles["keys"].to_pylist(), sizes, strict=True)])
        facts = np.concatenate([_unpacked(data, n, np.uint32, 3) for data, n in zip(bundles["facts"].to_pylist(), sizes, strict=True)])
        ends = np.cumsum(list(map(len, docs)))[:-1]
        docs = np.concatenate(docs)
        of = np.repeat(np.arange(len(docs), dtype=np.int32), docs[:, 3])
        _, kind = np.unique(keys, return_inverse=True)
        others = []
        for bit in (1, 2):
            mine = facts[:, 0] * ((docs[:, 2] & bit) > 0)[of]
            others.append(np.bincount(kind, weights=mine)[kind] - mine)
        hit = others[0] > 0
        times, own, word = facts[hit].astype(np.int64).T
        place, of = np.where(word > 0, word - 1, keys[hit] & ((1 << 32) - 1)), of[hit]
        changes = np.zeros((2, len(docs)), np.int64)
        for side, bit in enumerate((1, 2)):
            counted = ((docs[:, 2] & bit) > 0)[of].astype(np.int64)
            share = BACKOFF * (self.hot_words[1 + side][place] - own * counted + 1) / (self.totals[side] - docs[of, 1].astype(np.int64) * counted + self.size)
            np.add.at(changes[side], of, np.rint(-times * np.log(others[side][hit] / share + 1) * UNIT).astype(np.int64))
        some, rows = np.zeros(len(docs), bool), []
        some[of] = True
        for chunk, one, changed, left in zip(bundles["chunk"].to_pylist(), np.split(docs[:, 0], ends), np.split(changes, ends, axis=1), np.split(some, ends), strict=True):
            if left.any():
                rows.append((chunk, int(left.sum()), _packed(np.stack([one[left].astype(np.int64), *changed[:, left]], axis=1))))
        found = [_batch(dict(zip(("chunk", "n_docs", "changes"), zip(*rows, strict=True), strict=True)), MET)] if rows else []
        return pa.concat_tables([texts, pa.Table.from_batches(found, texts.schema)])

    def rare(self, keys: np.ndarray, sequences: list[np.ndarray], marked: np.ndarray, counted: np.ndarray) -> dict[str, np.ndarray]:
        """A row for each bigram that ends in a word that is not hot; the first of a word also stands for the word as a predecessor.

        START has no bigram that ends in it, so it has a row of its own where it is not hot.
        """
        ids, doc, lengths = _joined(sequences)
        at = np.nonzero(~_has(ids, self.hot_words[0]))[0]
        _, times, group = _groups(doc[at], ids[at])
        own = np.zeros(len(ids), np.int64)
        own[at] = times[group]
        starts, ends = at[ids[at] == START], at[ids[at] != START]
        g_first, g_times, _ = _groups(doc[ends], pair_keys(ids[ends - 1], ids[ends]))
        ends = ends[g_first]
        heads, _, _ = _groups(doc[ends], ids[ends])
        leads = np.zeros(len(ends), bool)
        leads[heads] = True
        leads &= ids[ends] != END
        places = np.concatenate([starts, ends])
        return {
            "row_key": keys[doc[places]],
            "rare_word": ids[places],
            "own": own[places],
            "gram": np.concatenate([np.zeros(len(starts), bool), np.ones(len(ends), bool)]),
            "leads": np.concatenate([np.ones(len(starts), bool), leads]),
            "key": np.concatenate([keys[doc[starts]], pair_keys(ids[ends - 1], ids[ends])]),
            "times": np.concatenate([np.zeros(len(starts), np.int64), g_times]),
            "n_tokens": (lengths - 1)[doc[places]],
            "marked": marked[doc[places]],
            "counted": counted[doc[places]],
        }


KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
LOSSES = {"chunk": "long", "doc": "int", "row_key": "long", "n_tokens": "int", "background": "long", "target": "long"}
MET = {**LOSSES, "n_docs": "int", "changes": "binary"}
NEAR = {"bucket": "int", **LOSSES, "n_docs": "int", "docs": "binary", "keys": "binary", "facts": "binary"}
RARE = {"row_key": "long", "rare_word": "long", "own": "int", "gram": "boolean", "leads": "boolean", "key": "long", "times": "int", "n_tokens": "int", "marked": "boolean", "counted": "boolean"}


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def _batch(found: dict, fields: dict[str, str]) -> pa.RecordBatch:
    """A batch with the columns of ``fields``, null where ``found`` has none."""
    rows = len(next(iter(found.values())))
    columns = [pa.array(found[name], KINDS[kind]) if name in found else pa.nulls(rows, KINDS[kind]) for name, kind in fields.items()]
    return pa.RecordBatch.from_arrays(columns, list(fields))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Row keys, sequences and marks of texts, some SCORED tokens at a time."""
    codes = Codes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        keys, marked, counted = (np.array(batch.column(c).to_pylist()) for c in ("row_key", "marked", "counted"))
        begin, held, tokens = 0, [], 0
        for n, text in enumerate(texts, 1):
            held.append(sequence(text, codes))
            tokens += len(held[-1])
            if tokens < SCORED and n < len(texts):
                continue
            yield keys[begin:n], held, marked[begin:n], counted[begin:n]
            begin, held, tokens = n, [], 0


def _rare_rows(ids: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            yield _batch(shared.value.rare(*piece), RARE)

    return ids.mapInArrow(run, _schema(RARE))


def _changed(table: pa.Table) -> pa.Table:
    """The texts of one chunk, with what its bigrams in all buckets change in their losses; a text that stands for a repeated chunk has the changes of all."""
    texts, bundles = (table.filter(pc.is_valid(table[c])) for c in ("row_key", "changes"))
    doc, first = np.unique(texts["doc"].to_numpy(), return_index=True)
    losses = np.stack([texts[s].to_numpy() for s in SIDES])
    for data, n in zip(bundles["changes"].to_pylist(), bundles["n_docs"].to_pylist(), strict=True):
        of, *changes = _unpacked(data, n, np.int64, 3).T
        losses[:, first[np.searchsorted(doc, of)]] += changes
    return pa.Table.from_arrays([texts["row_key"], texts["n_tokens"], *map(pa.array, losses), pa.array(np.ones(len(texts), np.int64))], names=["row_key", "n_tokens", *SIDES, "copies"])


def _near_rows(ids: DataFrame, shared, buckets: int) -> DataFrame:
    """A row for each text, and for each chunk of texts and each bucket one that holds the chunk's bigrams in the bucket, text by text.

    A chunk is named by the keys of its texts in order, so that it has the same name whenever it is made anew.
    """

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        row_keys, tokens, flags, losses, doc, keys, facts = (np.concatenate(c, axis=-1 if n == 3 else 0) for n, c in enumerate(zip(*held, strict=True)))
        chunk = xxhash.xxh64_intdigest(row_keys.tobytes())
        chunk -= (chunk >> 63) << 64
        places = np.arange(len(row_keys))
        texts = {"bucket": (places + chunk) % buckets, "chunk": np.full(len(places), chunk), "doc": places, "row_key": row_keys, "n_tokens": tokens}
        yield _batch(texts | dict(zip(SIDES, losses, strict=True)), NEAR)
        bucket = ((keys.view(np.uint64) * PAIRING >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        rows = []
        for b, at in enumerate(np.split(order, ends[:-1])):
            if len(at):
                of, n = np.unique(doc[at], return_counts=True)
                docs = np.stack([of, tokens[of], flags[of], n], axis=1).astype(np.uint32)
                rows.append((b, chunk, len(of), _packed(docs), _packed(keys[at]), _packed(facts[at])))
        if rows:
            yield _batch(dict(zip(("bucket", "chunk", "n_docs", "docs", "keys", "facts"), zip(*rows, strict=True), strict=True)), NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, seen = [], 0, 0
        for row_keys, sequences, marked, counted in _pieces(batches):
            losses, doc, keys, facts = shared.value.near(sequences, marked, counted)
            tokens = np.maximum(np.array(list(map(len, sequences))) - 1, 0)
            held.append((row_keys, tokens, counted * 1 + (marked & counted) * 2, losses, doc.astype(np.int32) + texts, keys, facts))
            texts, seen = texts + len(row_keys), seen + int(tokens.sum())
            if seen >= CHUNK or texts >= CHUNK_TEXTS:
                yield from out(held)
                held, texts, seen = [], 0, 0
        if held:
            yield from out(held)

    return ids.mapInArrow(run, _schema(NEAR))


def score(docs: DataFrame, models: Models) -> DataFrame:
    """Rows ``(doc_id, n_words, ce_background, ce_target, score)`` of ``docs(doc_id, text, target, counted)``; score is target less background, lower is nearer the target.

    A word after another has the probability (n + BACKOFF p) / (m + BACKOFF), from the bigram's count n, the
    predecessor's m, and the word's own share p = (c + 1) / (all + vocabulary), which adds up to 1. ``models``
    are those of the rows with ``counted``; such a row is scored by the counts less its own, so a document is
    never likely because it was counted itself. Other rows are only scored.

    Each text's words and bigrams are added up first. Bigrams that are not frequent are shuffled once, to meet
    the others of their kind: that counts them, exactly, and as frequent ones are not among them, no key is
    hot. Those seen elsewhere then correct their texts' losses. Bigrams that end in a hot word travel in bundles, as
    they are nearly as many as words; a bucket of keys is counted by one task. Of the words only rare ones are looked up in
    the table of counts; the others, which are bounded, are broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.xxhash64("doc_id", "text").alias("row_key")
    ids = docs.select(key, "text", F.coalesce("target", F.lit(False)).alias("marked"), "counted")
    own = [F.col("counted").cast("int"), (F.col("counted") & F.col("marked")).cast("int")]

    def share(n: int, count: str) -> Column:
        rest = F.coalesce(count, F.lit(0)) - F.col("own") * own[n]
        return BACKOFF * (rest + 1) / (F.lit(models.totals[n]) - F.col("n_tokens") * own[n] + models.size)

    words = models.words.where(F.col("background") < models.least).select(F.col("key").alias("rare_word"), *[F.col(s).alias(f"c_{s}") for s in SIDES])
    shared = spark.sparkContext.broadcast(Scorer(models))
    rare = _rare_rows(ids, shared).join(words, "rare_word", "left")
    gram, leads = F.col("gram"), F.col("leads")
    before = [F.when(leads, F.col("own") * F.log(F.coalesce(f"c_{s}", F.lit(0)) - F.col("own") * own[n] + BACKOFF)).otherwise(0.0) for n, s in enumerate(SIDES)]
    shares = [share(n, f"c_{s}") for n, s in enumerate(SIDES)]

    def row(key: Column, times: Column, values: list[Column]) -> Column:
        return F.struct("row_key", key.alias("key"), times.alias("times"), own[0].alias("of_background"), own[1].alias("of_target"), *[v.alias(s) for v, s in zip(values, SIDES, strict=True)])

    # a word that occurs in this text alone has no bigram elsewhere, so its row is closed at once
    alone = gram & (F.coalesce("c_background", F.lit(0)) - F.col("own") * own[0] <= 0)
    closed = row(F.col("row_key"), F.lit(0), [b - F.when(gram, F.col("times") * F.log(x)).otherwise(0.0) for b, x in zip(before, shares, strict=True)])
    waits = row(F.col("key"), F.col("times"), shares)
    both = F.array_compact(F.array(waits, F.when(leads, row(F.col("row_key"), F.lit(0), before))))
    made = rare.select(F.explode(F.when(alone | ~gram, F.array(closed)).otherwise(both)).alias("r")).select("r.*")
    together, losses = Window.partitionBy("key"), []
    for s in SIDES:
        mine = F.col("times") * F.col(f"of_{s}")
        made = made.withColumn(f"n_{s}", F.sum(mine).over(together) - mine)
        nats = F.when(F.col("times") > 0, -F.col("times") * F.log(F.col(f"n_{s}") + F.col(s))).otherwise(F.col(s))
        losses.append(F.sum(F.round(nats * UNIT).cast("long")).alias(s))
    of_rare = made.groupBy("row_key").agg(*losses).select("row_key", F.lit(None).cast("int").alias("n_tokens"), *SIDES, F.lit(0).cast("long").alias("copies"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    near = _near_rows(ids, shared, size // BUCKET_BYTES + 1)
    met = near.groupBy("bucket").applyInArrow(lambda table: shared.value.met(table), _schema(MET))
    texts = met.groupBy("chunk").applyInArrow(_changed, "row_key long, n_tokens int, background long, target long, copies long")
    sums = texts.union(of_rare).groupBy("row_key").agg(*[F.sum(c).alias(c) for c in (*SIDES, "copies")], F.max("n_tokens").alias("n_tokens"))
    tokens = F.col("n_tokens")
    nats = [F.when(tokens > 0, F.col(s) / F.col("copies") / F.lit(float(UNIT)) / tokens).alias(f"ce_{s}") for s in SIDES]
    scored = docs.select(key, "doc_id").join(sums, "row_key").select("doc_id", F.greatest(tokens - 1, F.lit(0)).cast("long").alias("n_words"), *nats)
    return scored.withColumn("score", F.col("ce_target") - F.col("ce_background"))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Score every row of ``docs(doc_id, text, ...)`` for likeness to the documents in ``target_ids(doc_id)``.

    A null, empty or white-space text has 0 words and null scores. Repeated rows count and are scored
    each, by counts less one of them; null ids are in no target; with an empty target its model is uniform
    over the vocabulary. Extra columns are not read; an empty table gives an empty result.
    """
    ids = stored(target_ids.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True)), "target-ids")
    joined = docs.select("doc_id", "text").join(broadcast_if_small(ids, IDS_ROWS), "doc_id", "left")
    marked = joined.withColumns({"target": F.coalesce("target", F.lit(False)), "counted": F.lit(True)})
    return score(marked, fit(marked))
