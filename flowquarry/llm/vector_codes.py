"""Vector code compression by active-entry Lloyd: parts compare only the entries that moved, where their own stayed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import broadcast_if_small, drop_stored, small_batches, stored
from flowquarry.llm.vectors import finite, matrix, usual_length, whole_numbers

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2


def bound(width: int) -> int:
    """The largest component, so that a vector's squared distances add up within a long."""
    return 1 << (60 - max(width - 1, 1).bit_length()) // 2


def nearest(x: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest entry of ``book`` of those in ``among`` (rising indices), the first of equals, and its distance."""
    off = x[:, None, :] - book[among]
    distance = np.einsum("nep,nep->ne", off, off)
    best = distance.argmin(axis=1)
    return among[best], distance[np.arange(len(x)), best]


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, distance: np.ndarray, moved: np.ndarray) -> None:
    """Bring ``code`` and ``distance`` of one part position up to date, in place, after the entries marked in ``moved`` changed.

    Where a row's entry stayed, its stored distance is still exact and so are those to all entries that stayed, none
    of which is nearer: only moved entries can win, or tie at a lower index. Other rows look at all entries.
    """
    stayed = (code >= 0) & ~moved[code]
    active = np.flatnonzero(moved)
    if len(active) and stayed.any():
        at = np.flatnonzero(stayed)
        entry, near = nearest(x[at], book, active)
        better = (near < distance[at]) | ((near == distance[at]) & (entry < code[at]))
        code[at[better]], distance[at[better]] = entry[better], near[better]
    at = np.flatnonzero(~stayed)
    if len(at):
        code[at], distance[at] = nearest(x[at], book, np.arange(len(book)))


def _assign(batches: Iterator[pa.RecordBatch], books: np.ndarray, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        x = matrix(batch.column("x"), parts * width).reshape(-1, parts, width)
        if "code" in batch.schema.names:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            distance = matrix(batch.column("distance"), parts).copy()
        else:
            code, distance = np.full((len(x), parts), -1), np.zeros((len(x), parts), np.int64)
        for p in range(parts):
            reassign(x[:, p], books[p], code[:, p], distance[:, p], moved[p])
        ends = pa.array(np.arange(len(x) + 1) * parts, pa.int32())
        made = [pa.array([row.tobytes() for row in code.astype(np.uint8)], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(distance.ravel()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), *made], ["vec_id", "label", "x", "code", "distance"])


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's sums and counts of the parts assigned to each entry."""
    parts, entries, width = books.shape
    total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for batch in batches:
        x = matrix(batch.column("x"), parts * width).reshape(-1, width)
        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
        at = (code + np.arange(parts) * entries).ravel()
        np.add.at(total, at, x)
        count += np.bincount(at, minlength=len(count))
    used = np.flatnonzero(count)
    if len(used):
        columns = [np.repeat(used, width), np.tile(np.arange(width), len(used)), total[used].ravel(), np.repeat(count[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entry", "place", "total", "n"])


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after each used entry became the floor of its parts' mean; at most one row per number reaches the driver."""
    sums = state.select("x", "code").mapInArrow(partial(_sums, books=books), "entry long, place long, total long, n long")
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    out = books.reshape(-1, books.shape[2]).copy()
    for row in sums.groupBy("entry", "place").agg(exact, F.sum("n").alias("n")).collect():
        out[row.entry, row.place] = int(row.total) // row.n
    return out.reshape(books.shape)


def compress(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> tuple[DataFrame, np.ndarray]:
    """Rows ``(vec_id, label, x, code, distance)`` and the final codebooks, as parts x entries x places.

    Components become ``floor(256 c)``; a vector is cut into ``parts`` equal parts, filled up with zeros where its
    length does not divide. Codebooks start from the vectors with the smallest ids. Each of the ``rounds``
    assigns all parts and moves the entries; at last parts are assigned again. ``code`` has a byte for
    each part, so ``entries`` is 256 at most.

    Vectors that are null or empty, hold null, infinite or NaN components, or are not of the most frequent length (the longer of
    two as frequent) are dropped. Components beyond :func:`bound` count as that. Null ids come last among those that start
    codebooks, and vectors with equal ids are in the order of their components. With fewer vectors than entries all of them start the codebooks.
    """
    small_batches(rows.sparkSession)
    base = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label").where(finite(F.col("v")))
    length = usual_length(base, "v")
    fill = F.array_repeat(F.lit(0).cast("long"), -length % parts)
    x = F.concat(whole_numbers(F.col("v"), SCALE, bound(length)), fill)
    state = stored(base.where(F.size("v") == length).select("vec_id", "label", x.alias("x")), "vector-parts")
    first = state.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -(-max(length, 1) // parts)).transpose(1, 0, 2)
    moved = np.ones(books.shape[:2], bool)
    types = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label", "x"))
    for turn in range(rounds + 1):
        before, state = state, stored(state.mapInArrow(partial(_assign, books=books, moved=moved), f"{types}, code binary, distance array<long>"), "vector-codes")
        drop_stored(before)
        if turn < rounds:
            old, books = books, moved_books(state, books)
            moved = (books != old).any(axis=2)
    return state, books


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> DataFrame:
    """One row ``(vec_id, code, error, label_error, codebooks_sha256)`` per vector that :func:`compress` keeps.

    ``code`` has two hexadecimal digits for each part, ``error`` is the vector's squared distance from what its code stands for, and
    ``label_error`` the sum of errors over its label, nulls being one label; it is null where it does not fit in a long.
    Repeated rows stay repeated; other columns are not read; an empty table gives an empty result.
    """
    state, books = compress(rows, rounds, entries, parts)
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda total, d: total + d).alias("error")
    coded = state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), error)
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = broadcast_if_small(stored(sums.select(F.col("label").alias("of"), F.expr("try_cast(total as bigint)").alias("label_error")), "label-errors"), 100_000)
    joined = coded.join(sums, coded.label.eqNullSafe(sums.of))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same rows from SQL, all entries tried each time."""
    fine = "embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0"
    steps = [
        f"v as (select vec_id, label, list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) as x from embeddings where {fine})",
        f"p as (select vec_id, label, part, x[part * (len(x) // {PARTS}) + 1:(part + 1) * (len(x) // {PARTS})] as s from v, unnest(range({PARTS})) as t(part))",
        f"b0 as (select part, k - 1 as e, s from (select part, s, row_number() over (partition by part order by vec_id) as k from p) where k <= {ENTRIES})",
    ]
    off = "list_sum(list_transform(list_zip(p.s, b{0}.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for turn in range(rounds + 1):
        best = f"min(cast({off.format(turn)} as hugeint) * {ENTRIES} + e)"
        steps.append(f"a{turn} as (select vec_id, label, part, any_value(p.s) as s, {best} as best from p join b{turn} using (part) group by all)")
        if turn < rounds:
            steps += [
                f"t{turn} as (select part, cast(best % {ENTRIES} as bigint) as e, place, sum(s[place]) as total, count(*) as n from a{turn}, unnest(range(1, len(s) + 1)) as t(place) group by all)",
                f"m{turn} as (select part, e, list(cast((total - ((total % n) + n) % n) // n as bigint) order by place) as s from t{turn} group by all)",
                f"b{turn + 1} as (select part, e, coalesce(m{turn}.s, b{turn}.s) as s from b{turn} left join m{turn} using (part, e))",
            ]
    return (
        f"with {', '.join(steps)}, "
        f"o as (select vec_id, label, string_agg(lower(printf('%02x', cast(best % {ENTRIES} as int))), '' order by part) as code, cast(sum(best // {ENTRIES}) as bigint) as error from a{rounds} group by all) "
        "select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, "
        f"(select sha256(string_agg(array_to_string(s, ','), ',' order by part, e)) from b{rounds}) as codebooks_sha256 from o"
    )
