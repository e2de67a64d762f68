"""Embedding whitening by spectrum slicing: inertia counts isolate eigenvalues, Rayleigh quotient iteration finds them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import small_batches, stored
from flowquarry.llm.vectors import exact_sums, finite, matrix, matrix_sum, usual_length, whole_numbers

#: Entries become ``floor(SCALE * c) + SHIFT``; beyond BOUND they would not fit in a long.
SCALE, SHIFT, BOUND = 64, 1_000_000, 1 << 60
COMPONENTS = 16
#: Bunch and Kaufman's bound on pivots.
PIVOT = (1 + 17**0.5) / 8
EPS = float(np.finfo(float).eps)


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` exceed ``shift``: positive pivots of the LDLᵀ of ``v - shift I``.

    Pivots are 1 x 1 or 2 x 2 as Bunch and Kaufman choose them; a 2 x 2 pivot has one eigenvalue of either sign.
    """
    a = v - shift * np.eye(len(v))
    positive = at = 0
    while at < len(a):
        below = np.abs(a[at + 1 :, at])
        size, most = 1, below.max(initial=0.0)
        if most > 0 and abs(a[at, at]) < PIVOT * most:
            row = at + 1 + int(below.argmax())
            across = np.abs(a[row, at:])
            across[row - at] = 0
            widest = across.max()
            if abs(a[at, at]) * widest < PIVOT * most * most:
                size = 1 if abs(a[row, row]) >= PIVOT * widest else 2
                to = at + size - 1
                a[[to, row]] = a[[row, to]]
                a[:, [to, row]] = a[:, [row, to]]
        pivot, rest = a[at : at + size, at : at + size], a[at + size :, at : at + size]
        if size == 2:
            positive += 1
        else:
            positive += int(pivot[0, 0] > 0)
        if size == 2 or pivot[0, 0] != 0:
            a[at + size :, at + size :] -= rest @ np.linalg.solve(pivot, rest.T)
        at += size
    return positive


class Spectrum:
    """The inertia counts of a symmetric matrix known so far, from the outermost bounds on."""

    def __init__(self, v: np.ndarray):
        self.v = v
        off = np.abs(v).sum(axis=1) - np.abs(v.diagonal())
        low, high = float((v.diagonal() - off).min()), float((v.diagonal() + off).max())
        self.norm = max(abs(low), abs(high))
        self.tolerance = 4 * len(v) * EPS * self.norm
        self.counts = {low - self.tolerance: len(v), high + self.tolerance: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.v, shift)
        return self.counts[shift]

    def slice(self, k: int) -> tuple[float, float]:
        """Shifts known to lie below and above the k-th largest eigenvalue, as near as any counted."""
        return max(s for s, n in self.counts.items() if n >= k), min(s for s, n in self.counts.items() if n < k)

    def halve(self, k: int) -> tuple[float, float]:
        low, high = self.slice(k)
        self.above((low + high) / 2)
        return self.slice(k)

    def isolated(self, k: int, low: float, high: float) -> bool:
        return self.counts[low] == k and self.counts[high] == k - 1


def _apart(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The unit vector of what is left of ``vector`` beside orthonormal ``others``."""
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def _inverse_step(v: np.ndarray, shift: float, vector: np.ndarray, nudge: float) -> np.ndarray:
    try:
        found = np.linalg.solve(v - shift * np.eye(len(v)), vector)
    except np.linalg.LinAlgError:
        found = np.linalg.solve(v - (shift + nudge) * np.eye(len(v)), vector)
    return found / np.linalg.norm(found) if np.isfinite(found).all() and found.any() else vector


def leading_pairs(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest positive eigenvalues of ``v``, falling, and their unit eigenvectors as columns.

    Halving by inertia counts isolates each eigenvalue in a slice; Rayleigh quotient iteration from there
    converges cubically. A value is taken if it lies in its slice, whose counts certify its number; if the iteration ran
    off to another, the slice is halved again. Eigenvalues that no slice wider than rounding tells apart are
    a cluster: each takes a direction of its own in their common space. Values not above rounding are left out. The entry of the
    largest amount is positive in each vector.
    """
    if not v.any():
        return np.zeros(0), np.zeros((len(v), 0))
    spectrum = Spectrum(v)
    values, vectors = [], []
    rng = np.random.default_rng(0)
    for k in range(1, min(wanted, len(v)) + 1):
        low, high = spectrum.slice(k)
        while not spectrum.isolated(k, low, high) and high - low > spectrum.tolerance:
            low, high = spectrum.halve(k)
        if high <= spectrum.tolerance:
            break
        while True:
            alone, nudge = spectrum.isolated(k, low, high), max(spectrum.tolerance / 8, np.finfo(float).tiny)
            vector, shift = _apart(rng.standard_normal(len(v)), vectors), (low + high) / 2
            for _ in range(3):
                vector = _apart(_inverse_step(v, shift, vector, nudge), vectors)
            for _ in range(12 if alone else 0):
                value = float(vector @ v @ vector)
                if np.linalg.norm(v @ vector - value * vector) <= EPS * spectrum.norm:
                    break
                vector = _apart(_inverse_step(v, value, vector, nudge), vectors)
            value = float(vector @ v @ vector)
            small = np.linalg.norm(v @ vector - value * vector) <= spectrum.tolerance
            if (small and low - spectrum.tolerance <= value <= high + spectrum.tolerance) or high - low <= spectrum.tolerance:
                break
            low, high = spectrum.halve(k)
        if value <= spectrum.tolerance:
            break
        values.append(value)
        vectors.append(vector * np.sign(vector[np.abs(vector).argmax()]))
    return np.array(values), np.array(vectors).T.reshape(len(v), len(values))


def centred(batch: pa.RecordBatch, n: int, sums: list[int]) -> np.ndarray:
    """The batch's vectors less the mean ``sums / n``, as doubles: whole numbers first, then the fraction."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (matrix(batch.column("x"), len(sums)) - base) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the exact sum over places of ``(n x - sum)²``; None where it does not fit in a long."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums))
    if most * most * len(sums) < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [int(d) if d < 1 << 63 else None for d in (off * off).sum(axis=1)]


def fit(distinct: DataFrame, width: int, components: int) -> dict | None:
    """Of ``distinct(x)``: number, sums, axes over root eigenvalues, shares explained and the error of the whitened covariance."""
    n = distinct.count()
    if not n or not width:
        return None
    sums = exact_sums(distinct, "x", width)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(batch, n, sums)
        return y.T @ y

    v = matrix_sum(distinct, products) / n
    values, vectors = leading_pairs(v, components)
    if not len(values):
        return None
    axes = vectors / np.sqrt(values)
    mean = matrix_sum(distinct, lambda batch: (centred(batch, n, sums) @ axes).sum(axis=0, keepdims=True))[0] / n

    def white_products(batch: pa.RecordBatch) -> np.ndarray:
        w = centred(batch, n, sums) @ axes - mean
        return w.T @ w

    error = float(np.abs(matrix_sum(distinct, white_products) / n - np.eye(len(values))).max())
    return {"n": n, "sums": sums, "axes": axes, "explained": values / np.trace(v), "identity_error": error}


def _whitened(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    n, sums, axes = model["n"], model["sums"], model["axes"]
    for batch in batches:
        white = centred(batch, n, sums) @ axes
        off = pa.array(deviations(matrix(batch.column("x"), len(sums)), n, sums), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * axes.shape[1], pa.int32()), pa.array(white.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), off, lists], ["vec_id", "deviation", "whitened"])


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of ``rows(vec_id, embedding, ...)``.

    Entries become the longs ``floor(64 c) + 1000000``. Each different vector counts once in ``n``, the mean and all
    covariances (divisor n, centred before multiplying). There is a row for each vector and each leading component:
    unit eigenvectors of the covariance by falling eigenvalue, as many as ``components`` at most and as have variance.
    ``whitened`` is the centred vector's projection over the eigenvalue's root, ``explained`` the eigenvalue's share of the trace,
    ``identity_error`` how far the covariance of the whitened vectors is from the identity, measured over all of
    them. ``deviation`` is exact, null where it does not fit in a long.

    A vector that is null or empty or holds null, infinite or NaN entries is dropped, and so is one whose length is not the
    most frequent (the longer of two as frequent). Entries beyond 2^60 / 64 count as that. Repeated rows stay repeated, a null vec_id is an id like any other,
    other columns are not read. Without variance (a single vector, all alike) and for an empty table the result is empty.
    """
    spark = rows.sparkSession
    small_batches(spark)
    base = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(finite(F.col("v")))
    width = usual_length(base, "v")
    longs = F.transform(whole_numbers(F.col("v"), SCALE, BOUND), lambda x: x + F.lit(SHIFT).cast("long"))
    base = base.where(F.size("v") == width).select("vec_id", longs.alias("x"))
    model = fit(stored(base.select("x").distinct(), "different-vectors"), width, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, deviation long, whitened array<double>"
    found = base.where(F.lit(model is not None)).mapInArrow(partial(_whitened, model=model), shape)
    many = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n, error, shares = (model["n"], model["identity_error"], model["explained"]) if model else (0, 0.0, [])
    share = F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>")
    return many.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
