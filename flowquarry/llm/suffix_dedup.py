"""Repeated byte strings by bucket-pointer refinement, from q-gram buckets to buckets of whole windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import small_batches, stored

#: Bytes of a repeated string. Buckets start as quarters of it and are refined twice by later offsets.
WINDOW = 400
GRAM = WINDOW // 4
#: Window starts worked on at once, which bounds the arrays of a very long text; low bits of an order key hold the place.
CHUNK = 1 << 17
PLACE_BITS = 18
PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: Window starts of a part of a run.
PART = 16
EMPTY = np.zeros(0, np.int64)
#: Columns of the result after the id.
CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
#: Odd constants of the hash that names a pair of buckets.
LEFT, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of buckets refined by the buckets of later offsets: 64-bit hashes of pairs of names."""
    out = left * LEFT
    out += right
    out ^= out >> np.uint64(32)
    out *= SPREAD
    out ^= out >> np.uint64(29)
    return out


def gram_buckets(raw: np.ndarray) -> np.ndarray:
    """The initial bucket of each offset: 8 bytes name themselves, and pairs of names double up to ``GRAM`` bytes.

    ``raw`` has at least ``GRAM`` bytes; the result has a bucket for each offset with as many bytes after it.
    """
    names, length = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)), 8
    while length < GRAM:
        step = min(length, GRAM - length)
        names = pair_name(names[:-step], names[step:])
        length += step
    return names


def window_buckets(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The buckets of whole windows that start at ``at``: refined by the bucket ``GRAM`` later, and so again by twice that."""
    halves = [pair_name(grams[at + k * GRAM], grams[at + (k + 1) * GRAM]) for k in (0, 2)]
    return pair_name(*halves)


def least_gram(grams: np.ndarray) -> np.ndarray:
    """For each window start the offset of the gram in it that comes first in bucket order, the leftmost of equal ones."""
    width = WINDOW - GRAM + 1
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        key = np.minimum(key[:-step], key[step:])
        span += step
    return (key & PLACE).astype(np.int64)


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, and where each starts."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def _chunks(raw: np.ndarray, starts: np.ndarray):
    """Pieces ``(first offset, gram buckets, window starts that stay within one text)``."""
    for low in range(0, len(raw) - WINDOW + 1, CHUNK):
        part = raw[low : low + CHUNK + WINDOW - 1]
        inside = np.zeros(len(part) - WINDOW + 1, bool)
        first = max(int(np.searchsorted(starts, low, "right")) - 1, 0)
        for begin, end in zip(starts[first:-1], starts[first + 1 :], strict=True):
            if begin >= low + len(inside):
                break
            inside[max(begin - low, 0) : max(end - WINDOW + 1 - low, 0)] = True
        if inside.any():
            yield low, gram_buckets(part), np.flatnonzero(inside)


def anchor_rows(texts: list[str | None]) -> list[np.ndarray]:
    """Columns ``(text, gram, around, low, high, place)``, one row for each run of windows that have the same least gram.

    ``low`` and ``high`` are the first and last window start of the run within its text; ``gram`` is the least
    gram's bucket, ``place`` how far it lies behind ``low``, and ``around`` names all the run's bytes with that place.
    """
    raw, starts = _joined(texts)
    found = []
    for offset, grams, at in _chunks(raw, starts):
        least = least_gram(grams)[at]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(least) != 0)]))
        low, high, least = at[new], at[np.append(new[1:], len(at)) - 1], least[new]
        shape = (least - low + (high - low) * WINDOW).astype(np.uint64)
        around = pair_name(pair_name(window_buckets(grams, low), window_buckets(grams, high)), shape)
        text = np.searchsorted(starts, low + offset, "right") - 1
        found.append([text, grams[least].view(np.int64), around.view(np.int64), low + offset - starts[text], high + offset - starts[text], least - low])
    if not found:
        return [EMPTY] * 6
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def anchors(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, row_key, bucket, around, low, high, place, n)``: the runs of :func:`anchor_rows` over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gram, around, low, high, place = anchor_rows(batch.column("text").to_pylist())
            at = pa.array(text)
            ints = [pa.array(c, pa.int32()) for c in (low, high, place)]
            columns = [batch.column("doc_id").take(at), batch.column("row_key").take(at), pa.array(gram), pa.array(around), *ints]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "bucket", "around", "low", "high", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, row_key long, bucket long, around long, low int, high int, place int"
    return docs.mapInArrow(run, shape).withColumn("n", F.lit(1).cast("long"))


def refine(rows: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """One round over runs of window starts ``rows(bucket, around, n, ...)``: the runs that repeat, and those to refine further.

    ``bucket`` names bytes that all windows of a run have in common, ``around`` all their bytes, and ``n`` counts the
    occurrences a row stands for. A bucket of one occurrence is closed: its windows occur nowhere else. Runs with the
    same bytes throughout repeat, and are returned where they stand for one occurrence. Where a bucket has runs with
    unlike bytes, one run of each kind is returned with its count and the ``carried`` columns.
    """
    sizes = rows.groupBy("bucket").agg(F.sum("n").alias("total"), F.min("around").alias("least"), F.max("around").alias("most"))
    # written first: a join whose sides both come straight from a shuffle is one whose hot buckets Spark can split
    alike = stored(sizes.where("total > 1").select("bucket", (F.col("least") == F.col("most")).alias("alike")), "shared-sizes")
    shared = stored(rows.join(alike, "bucket"), "shared-buckets")
    unlike = shared.where("not alike")
    firsts = [F.first(c).alias(c) for c in carried]
    kinds = stored(unlike.groupBy("bucket", "around").agg(F.sum("n").alias("n"), *firsts), "bucket-kinds")
    spots = ["doc_id", "row_key", "low", "high"]
    again = unlike.where("n = 1").join(kinds.where("n > 1").select("bucket", "around"), ["bucket", "around"], "left_semi")
    return shared.where("alike and n = 1").select(*spots).union(again.select(*spots)), kinds


def contexts(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """``kinds`` with the bytes of their windows, taken from the texts of ``docs``, as ``raw``."""
    wanted = F.struct("bucket", "around", "n", "low", "high", "place")
    lists = kinds.groupBy("doc_id", "row_key").agg(F.collect_list(wanted).alias("runs"))
    lists = lists.select(F.col("doc_id").alias("of"), F.col("row_key").alias("of_key"), "runs")
    held = docs.join(lists, (docs.row_key == lists.of_key) & docs.doc_id.eqNullSafe(lists.of)).select("doc_id", "row_key", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            flat, sizes = runs.flatten(), runs.value_lengths().to_numpy()
            text = np.repeat(np.arange(len(sizes)), sizes)
            data = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            low, high = (flat.field(c).to_numpy() for c in (3, 4))
            raw = [data[t][a : b + WINDOW] for t, a, b in zip(text.tolist(), low.tolist(), high.tolist(), strict=True)]
            at = pa.array(text)
            columns = [batch.column("doc_id").take(at), batch.column("row_key").take(at), *flat.flatten(), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "bucket", "around", "n", "low", "high", "place", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc_id {kind}, row_key long, bucket long, around long, n long, low int, high int, place int, raw binary")


def _parts(grams: np.ndarray, gram: np.uint64, place: int, last: int) -> list[np.ndarray]:
    """A run's window starts 0 to ``last`` by parts of ``PART``, counted from the anchor: columns ``(bucket, around, low, high, part)``.

    The parts of equal runs are equal wherever the runs begin. What a part's windows have in common is named by four
    grams, its bytes by its first and last window.
    """
    part = np.arange((place - last) // PART, place // PART + 1)
    top = place - part * PART
    low, high = np.maximum(top - PART + 1, 0), np.minimum(top, last)
    common = [grams[top + k] for k in (0, GRAM, 2 * GRAM, 3 * GRAM - PART + 1)]
    core = pair_name(pair_name(*common[:2]), pair_name(*common[2:]))
    ends = ((high - place + WINDOW) * 2 * WINDOW + low - place + WINDOW).astype(np.uint64)
    around = pair_name(pair_name(window_buckets(grams, low), window_buckets(grams, high)), ends)
    return [pair_name(pair_name(np.full(len(part), gram), core), part.astype(np.uint64)), around, low, high, part]


def _windows(grams: np.ndarray, gram: np.uint64, place: int, last: int, parts: list[int]) -> list[np.ndarray]:
    """The single window starts of some parts: columns ``(bucket, around, low, high, part)``, named by all their bytes."""
    at = np.concatenate([np.arange(max(place - p * PART - PART + 1, 0), min(place - p * PART, last) + 1) for p in parts])
    return [window_buckets(grams, at), np.full(len(at), gram), at, at, np.zeros(len(at), np.int64)]


def _split(with_parts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            chosen = batch.column("parts").to_pylist() if with_parts else [None] * len(batch)
            columns = [batch.column(c).to_pylist() for c in ("raw", "bucket", "low", "high", "place")]
            for i, (raw, gram, low, high, place, parts) in enumerate(zip(*columns, chosen, strict=True)):
                grams, name = gram_buckets(np.frombuffer(raw, np.uint8)), np.uint64(gram % (1 << 64))
                own = _windows(grams, name, place, high - low, parts) if with_parts else _parts(grams, name, place, high - low)
                found.append([own[0].view(np.int64), own[1].view(np.int64), own[2] + low, own[3] + low, own[4]])
                rows.append(np.full(len(own[0]), i))
            if not found:
                continue
            at = pa.array(np.concatenate(rows))
            made = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            made[2:] = [c.cast(pa.int32()) for c in made[2:]]
            kept = [batch.column(c).take(at) for c in ("doc_id", "row_key", "n", "bucket", "around")]
            yield pa.RecordBatch.from_arrays([*kept, *made], ["doc_id", "row_key", "n", "gram", "run", "bucket", "around", "low", "high", "part"])

    return run


def repeated_starts(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, row_key, low, high)``: first and last start of runs of windows that also start elsewhere, of ``docs(doc_id, row_key, text)``.

    Three rounds refine buckets of window starts. First come runs of windows with the same least gram, bucketed by that
    gram: every window has one, so windows that are equal share a bucket, and only one start in some hundred is looked
    at. Runs that neither repeat whole nor stand alone are split into parts of ``PART`` starts, bucketed by the bytes
    that a part's windows share; what is still open, into single starts bucketed by the whole window.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, row_key long, n long, gram long, run long, bucket long, around long, low int, high int, part int"
    found, kinds = refine(stored(anchors(docs), "anchors"), "doc_id", "row_key", "low", "high", "place")
    runs = stored(contexts(docs, kinds), "open-runs")
    more, parts = refine(stored(runs.mapInArrow(_split(False), shape), "run-parts"), "gram", "run", "part")
    wanted = parts.groupBy("gram", "run").agg(F.collect_set("part").alias("parts"))
    wanted = wanted.select(F.col("gram").alias("bucket"), F.col("run").alias("around"), "parts")
    last, _ = refine(stored(runs.join(wanted, ["bucket", "around"]).mapInArrow(_split(True), shape), "window-starts"))
    return found.union(more).union(last)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs"), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            begin, end = removed_runs(*(c.to_numpy() for c in runs.values.flatten())) if runs.is_valid else (EMPTY, EMPTY)
            kept, at = hashlib.sha256(), 0
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            spans = [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            rows.append((len(data), int((end - begin).sum()), len(begin), kept.hexdigest(), spans))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CUT_TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def removed_runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that windows starting from ``low`` to ``high`` cover."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64) + WINDOW)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    return low[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)`` per document of ``docs(doc_id, text, ...)``.

    Texts are read as UTF-8 bytes, a null one as empty. Each byte is removed that lies in a string of ``WINDOW`` bytes
    which also starts anywhere else in the input, in the same document or another; strings do not cross documents.
    ``spans`` are the maximal removed runs as ``(start, end)``, end exclusive, and ``kept_sha256`` is the digest of
    the other bytes. Buckets are named by 64-bit hashes, and strings count as equal where two of them agree.

    Texts shorter than ``WINDOW`` bytes keep all. Copies, and rows repeated whole, lose all from ``WINDOW`` bytes on.
    Null ids are ids like any other. Other columns are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    runs = repeated_starts(keyed.where(F.octet_length("text") >= WINDOW))
    lists = runs.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    lists = lists.select(F.col("doc_id").alias("of"), F.col("row_key").alias("of_key"), "runs")
    held = keyed.join(lists, (keyed.row_key == lists.of_key) & keyed.doc_id.eqNullSafe(lists.of), "left").select("doc_id", "text", "runs")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")



def oracle(window: int = WINDOW) -> str:
    """The same rows from SQL, by a digest of every window."""
    return (
        "with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents), "
        f"w as (select r, i, md5(b[i + 1:i + {window}]) as k from (select r, b, unnest(range(0, n - {window - 1})) as i from d where n >= {window})), "
        "again as (select k from w group by k having count(*) > 1), "
        "s as (select r, i from w where k in (select k from again)), "
        f"g as (select r, i, case when i <= lag(i) over (partition by r order by i) + {window} then 0 else 1 end as fresh from s), "
        "h as (select r, i, sum(fresh) over (partition by r order by i) as run from g), "
        f"spans as (select r, min(i) as a, max(i) + {window} as e from h group by r, run), "
        "pieces as (select r, a, e, coalesce(lag(e) over (partition by r order by a), 0) as back from spans), "
        "kept as (select r, sum(e - a) as removed, count(*) as spans, max(e) as last, string_agg(case when a > back then hex(b[back + 1:a]) else '' end, '' order by a) as parts from pieces join d using (r) group by r) "
        "select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, "
        "sha256(unhex(coalesce(parts, '') || case when n > coalesce(last, 0) then hex(b[coalesce(last, 0) + 1:n]) else '' end)) as kept_sha256 "
        "from d left join kept using (r)"
    )
