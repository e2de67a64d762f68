"""Reading vectors exactly: which rows have one, and their entries as whole numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import small_batches


def finite(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its entries are neither null nor infinite nor NaN."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def usual_length(rows: DataFrame, column: str) -> int:
    """The most frequent length of the vectors of ``column``, the longer of two as frequent; 0 where there are none."""
    sizes = rows.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0].d if found else 0


def whole_numbers(vector: Column, scale: int, bound: int) -> Column:
    """``floor(scale * c)`` for each entry c, as longs; what lies beyond ``bound`` counts as that."""
    held = lambda c: F.greatest(F.lit(float(-bound)), F.least(F.lit(float(bound)), c * F.lit(float(scale))))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("long"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def matrix_sum(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of ``rows`` of the matrices ``of`` makes, all of one shape; None without rows.

    Each task adds up its own batches; the tasks' matrices meet by matrix row. What reaches the driver is one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = of(batch) if total is None else total + of(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "entries"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "entries": [np.sum(np.stack(group["entries"].to_numpy()), axis=0)]})

    small_batches(rows.sparkSession)
    parts = rows.mapInArrow(run, "i int, entries array<double>")
    found = sorted((r.i, r.entries) for r in parts.groupBy("i").applyInPandas(add, "i int, entries array<double>").collect())
    return np.array([entries for _, entries in found]) if found else None


def exact_sums(rows: DataFrame, column: str, width: int) -> list[int]:
    """The exact sum of the long vectors of ``column`` at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            total += matrix(batch.column(0), width).astype(object).sum(axis=0) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(int(t)) for t in total])], ["place", "total"])

    parts = rows.select(column).mapInArrow(run, "place int, total string")
    sums = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    return [int(r.total) for r in sums.orderBy("place").collect()]
