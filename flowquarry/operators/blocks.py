"""Running figures of a key over its whole past, by blocks of time, so that one busy key is not one task's work.

A key's rows are cut into blocks of time, which go to different tasks. Each block is summed up in one row; an exclusive
prefix over a key's blocks, which are few, says what came before each; rows then add what their own block holds so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of a block of time.
BLOCK_US = 3_600_000_000


def block_of(time: Column, length_us: int = BLOCK_US) -> Column:
    return F.floor(time / length_us).cast("long")


def earlier_blocks(keys: list[str]) -> Window:
    """A key's blocks before each."""
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, before: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """``rows`` with the ``columns`` of their block in ``before(*keys, block, ...)``; null keys are keys like any other."""
    named = before.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("block").alias("of_block"), *columns)
    same = F.col("block") == F.col("of_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return rows.join(named, same).drop("of_block", *[f"of_{k}" for k in keys])


def _merged(keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks sorted by key and time, with the number, mean and squared distances of the blocks before each."""
        place, rows, n, mean, squares = None, 0, 0, 0.0, 0.0
        for batch in batches:
            past = []
            for r in batch.itertuples(index=False):
                at = [getattr(r, k) for k in keys]
                if at != place:
                    place, rows, n, mean, squares = at, 0, 0, 0.0, 0.0
                past.append((rows, n, mean, squares))
                rows += r.n_rows
                if r.n:
                    off, both = r.mean - mean, n + r.n
                    squares += r.squares + off * off * n * r.n / both
                    mean, n = (mean + off * r.n / both if n else r.mean), both
            made = pd.DataFrame(past, columns=["past_rows", "past_n", "past_mean", "past_squares"], index=batch.index)
            yield pd.concat([batch[[*keys, "block"]], made], axis=1)

    return run


def history(rows: DataFrame, keys: list[str], value: str, own: bool, length_us: int = BLOCK_US) -> DataFrame:
    """``rows`` with ``n_before``, ``mean_before`` and ``deviation_before`` of a value over their key's rows so far, the row itself included or not.

    Numbers, means and squared distances from the mean are merged, block by block and then with what a row's own block holds so far.
    """
    cut = rows.withColumn("block", block_of(F.col("t_us"), length_us))
    x = F.col(value).cast("double")
    sums = cut.groupBy(*keys, "block").agg(F.count("*").alias("n_rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("squares"))
    shape = T.StructType([*[cut.schema[k] for k in [*keys, "block"]], *T._parse_datatype_string("past_rows long, past_n long, past_mean double, past_squares double").fields])
    before = sums.repartition(*keys).sortWithinPartitions(*keys, "block").mapInPandas(_merged(keys), shape)
    w = Window.partitionBy(*keys, "block").orderBy("t_us", "flow_id").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    held = joined(cut, before, keys, "past_rows", "past_n", "past_mean", "past_squares")
    held = held.withColumns({"in_rows": F.count("*").over(w), "in_n": F.count(x).over(w), "in_mean": F.coalesce(F.avg(x).over(w), F.col("past_mean")), "in_spread": F.coalesce(F.var_pop(x).over(w), F.lit(0.0))})
    n, off = F.col("past_n") + F.col("in_n"), F.col("in_mean") - F.col("past_mean")
    share = F.col("in_n") / F.greatest(n, F.lit(1))
    squares = F.col("past_squares") + F.col("in_spread") * F.col("in_n") + off * off * F.col("past_n") * share
    made = {
        "n_before": F.col("past_rows") + F.col("in_rows"),
        "mean_before": F.when(F.col("past_n") == 0, F.when(n > 0, F.col("in_mean"))).otherwise(F.col("past_mean") + off * share),
        "deviation_before": F.when(n > 1, F.sqrt(squares / (n - 1))),
    }
    return held.select(*rows.columns, *[c.alias(name) for name, c in made.items()])


def running_sums(rows: DataFrame, keys: list[str], values: dict[str, Column], first: dict[str, Column], length_us: int = BLOCK_US, base: DataFrame | None = None) -> DataFrame:
    """``rows`` with sums of whole numbers over their key's rows so far, the row itself included, and values of the key's first row.

    ``base`` are the same rows without columns that are costly to work out: blocks are summed up from them.
    """
    added = {f"add_{n}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for n, v in values.items()}
    cut, plain = (df.withColumn("block", block_of(F.col("t_us"), length_us)).withColumns(added) for df in (rows, rows if base is None else base))
    order = F.struct("t_us", "flow_id")
    sums = plain.groupBy(*keys, "block").agg(*[F.sum(f"add_{n}").alias(f"past_{n}") for n in values], F.min(F.struct(order.alias("at"), *[v.alias(n) for n, v in first.items()])).alias("first"))
    past = earlier_blocks(keys)
    prefix = [F.coalesce(F.sum(f"past_{n}").over(past), F.lit(0)).alias(f"past_{n}") for n in values]
    before = sums.select(*keys, "block", *prefix, F.min("first").over(Window.partitionBy(*keys)).alias("first"))
    w = Window.partitionBy(*keys, "block").orderBy("t_us", "flow_id").rowsBetween(Window.unboundedPreceding, 0)
    held = joined(cut, before, keys, *[f"past_{n}" for n in values], "first")
    totals = [(F.col(f"past_{n}") + F.sum(f"add_{n}").over(w)).alias(n) for n in values]
    return held.select(*rows.columns, *totals, *[F.col("first")[n].alias(n) for n in first])


def quiet_segments(rows: DataFrame, keys: list[str], gap_us: int | Column, length_us: int = BLOCK_US) -> DataFrame:
    """``rows`` with ``segment``: a number that is one higher after each pause of their key of ``gap_us`` or longer.

    What a key remembers for less than the pause is empty at the start of a segment, so segments can go to different tasks.
    """
    cut = rows.withColumn("block", block_of(F.col("t_us"), length_us)).withColumn("pause_us", F.lit(gap_us) if isinstance(gap_us, int) else gap_us)
    within = Window.partitionBy(*keys, "block").orderBy("t_us")
    marked = cut.withColumn("breaks", F.coalesce((F.col("t_us") - F.lag("t_us").over(within) >= F.col("pause_us")).cast("int"), F.lit(0)))
    sums = marked.groupBy(*keys, "block").agg(F.sum("breaks").alias("n"), F.min("t_us").alias("low"), F.max("t_us").alias("high"), F.max("pause_us").alias("pause"))
    order = Window.partitionBy(*keys).orderBy("block")
    fresh = F.coalesce((F.col("low") - F.lag("high").over(order) >= F.col("pause")).cast("int"), F.lit(0))
    opened = sums.withColumn("fresh", fresh)
    before = opened.select(*keys, "block", (F.coalesce(F.sum("n").over(earlier_blocks(keys)), F.lit(0)) + F.sum("fresh").over(order)).alias("past_breaks"))
    so_far = within.rangeBetween(Window.unboundedPreceding, 0)
    held = joined(marked, before, keys, "past_breaks")
    return held.select(*rows.columns, (F.col("past_breaks") + F.sum("breaks").over(so_far)).alias("segment"))
