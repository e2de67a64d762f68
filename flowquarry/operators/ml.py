"""Anomaly scores: features, a baseline of deviations with its explanation, online means, and an isolation forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.blocks import BLOCK_US, block_of

FEATURES = ("bytes", "packets", "bytes_per_packet", "src_port", "dst_port", "protocol", "tcp_flags")


def features(flows: DataFrame) -> DataFrame:
    """Flows with ``bytes_per_packet`` and the seven features as an array of doubles."""
    out = flows.withColumn("bytes_per_packet", F.col("bytes") / F.greatest("packets", F.lit(1)))
    return out.withColumn("features", F.array(*[F.col(c).cast("double") for c in FEATURES]))


def baseline_stats(rows: DataFrame) -> DataFrame:
    """One row of means, population deviations (1 where they are 0) and maxima by feature."""
    out = []
    for c in FEATURES:
        s = F.stddev_pop(c)
        out += [F.avg(c).alias(f"mean_{c}"), F.when(s == 0, 1.0).otherwise(s).alias(f"sd_{c}"), F.max(c).alias(f"max_{c}")]
    return rows.agg(*out)


def deviations(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows that deviate far in bytes, or in packets of bare SYNs, against a baseline of one row."""
    joined = rows.crossJoin(F.broadcast(stats))
    z = lambda c: (F.col(c) - F.col(f"mean_{c}")) / F.greatest(F.col(f"sd_{c}"), F.lit(1.0))
    out = joined.withColumns({"z_bytes": z("bytes"), "z_packets": z("packets")})
    return out.where((F.col("z_bytes") > 5) | ((F.col("z_packets") > 4) & (F.col("tcp_flags") == 2)))


def explain(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``(flow_id, primary, share)``: the feature that deviates most, and its part of all deviations in percent."""
    joined = rows.crossJoin(F.broadcast(stats))
    parts = F.array(*[F.struct(F.abs((F.col(c) - F.col(f"mean_{c}")) / F.greatest(F.col(f"sd_{c}"), F.lit(0.001))).alias("z"), F.lit(c).alias("name")) for c in FEATURES])
    top = joined.select("flow_id", parts.alias("parts")).withColumn("top", F.array_max("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["z"])
    return top.select("flow_id", F.col("top.name").alias("primary"), F.when(total > 0, F.round(F.col("top.z") / total * 100, 1)).otherwise(0.0).alias("share"))


def moving_map(values: np.ndarray, alpha: float) -> tuple[float, ...]:
    """What weighted values do to the mean and variance before them, as ``(p, c, e0, e1, e2)``.

    The mean m becomes ``p m + c`` and the variance v ``p v + e0 + e1 m + e2 m²``. Such maps compose to one of their kind.
    """
    out, keep = (1.0, 0.0, 0.0, 0.0, 0.0), 1 - alpha
    size = max(1, int(27 / -np.log(keep))) if 0 < keep < 1 else 1  # so that powers stay within a double
    for at in range(0, len(values), size):
        x = values[at : at + size]
        powers = keep ** np.arange(len(x) + 1)
        c = powers[1:] * np.cumsum(alpha * x / powers[1:]) if keep > 0 else x
        apart, slope = x - np.concatenate([[0.0], c[:-1]]), powers[:-1]
        weight = alpha * powers[::-1][:-1]
        out = then(out, (powers[-1], c[-1], (weight * apart * apart).sum(), -2 * (weight * apart * slope).sum(), (weight * slope * slope).sum()))
    return tuple(map(float, out))


def then(one: tuple[float, ...], two: tuple[float, ...]) -> tuple[float, ...]:
    """The map of first ``one`` and then ``two``."""
    p1, c1, a0, a1, a2 = one
    p2, c2, b0, b1, b2 = two
    return p1 * p2, p2 * c1 + c2, p2 * a0 + b0 + b1 * c1 + b2 * c1 * c1, p2 * a1 + p1 * b1 + 2 * b2 * p1 * c1, p2 * a2 + b2 * p1 * p1


def online_means(rows: DataFrame, key: str, value: str, alpha: float = 0.01, length_us: int = BLOCK_US) -> DataFrame:
    """``(key, n, mean, std)`` of exponentially weighted values in time order.

    The first value of a key is its mean, with variance 1. A block of a key's time is one map of mean and variance, made where its rows
    are, of values and means less the block's first value, so that large values do not drown small deviations; a key's maps, which
    are few, are applied in order. So a busy key is spread over tasks by time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, n, first, so_far = None, 0, 0.0, (1.0, 0.0, 0.0, 0.0, 0.0)
        columns = ["k", "block", "n", "first", "p", "c", "e0", "e1", "e2"]
        for batch in batches:
            done = []
            for at, x in batch.groupby(["k", "block"], sort=False)["x"]:
                values = x.to_numpy()
                if at != place:
                    if n:
                        done.append((*place, n, first, *so_far))
                    place, n, first, so_far = at, 0, values[0], (1.0, 0.0, 0.0, 0.0, 0.0)
                    values, n = values[1:], 1
                so_far, n = then(so_far, moving_map(values - first, alpha)), n + len(values)
            yield pd.DataFrame(done, columns=columns)
        if n:
            yield pd.DataFrame([(*place, n, first, *so_far)], columns=columns)

    block = block_of(F.col("t_us"), length_us).alias("block")
    cut = rows.select(F.col(key).cast("string").alias("k"), block, F.col(value).cast("double").alias("x"), "t_us", "flow_id").where("k is not null and x is not null")
    spread = cut.repartition("k", "block").sortWithinPartitions("k", "block", "t_us", "flow_id")
    maps = spread.mapInPandas(run, "k string, block long, n long, first double, p double, c double, e0 double, e1 double, e2 double")
    listed = maps.groupBy("k").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(*maps.columns[1:]))).alias("maps"))
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(1.0).alias("var"))

    def apply(state: Column, m: Column) -> Column:
        off = m["first"] - state["mean"]
        mean = F.coalesce(state["mean"] + alpha * off, m["first"])
        var = F.coalesce((1 - alpha) * (state["var"] + alpha * off * off), F.lit(1.0))
        near = mean - m["first"]
        return F.struct((m["first"] + m["p"] * near + m["c"]).alias("mean"), (m["p"] * var + m["e0"] + m["e1"] * near + m["e2"] * near * near).alias("var"))

    ended = listed.withColumn("state", F.aggregate("maps", start, apply))
    std = F.greatest(F.lit(0.001), F.sqrt(F.greatest(F.lit(0.0), F.col("state.var"))))
    return ended.select(F.col("k").alias("key"), "n", F.col("state.mean").alias("mean"), std.alias("std"))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of nodes, the sample's size and the score above which a row is anomalous."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int
    cut: float = 0.5


def path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _tree(points: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, value, child, extra, todo = [], [], [], [], [(points, 0)]
    while todo:
        rows, depth = todo.pop(0)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(points.shape[1])
        if depth >= limit or len(rows) <= 1 or not spread.any():
            feature.append(-1), value.append(0.0), child.append(0), extra.append(depth + float(path_norm(len(rows))))
            continue
        f = int(rng.choice(np.nonzero(spread)[0]))
        at = rng.uniform(rows[:, f].min(), rows[:, f].max())
        feature.append(f), value.append(at), child.append(len(feature) + len(todo)), extra.append(0.0)
        todo += [(rows[rows[:, f] < at], depth + 1), (rows[rows[:, f] >= at], depth + 1)]
    return np.array(feature), np.array(value), np.array(child), np.array(extra)


def _scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    depth = np.zeros(len(x))
    for feature, value, child, extra in forest.trees:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                break
            at = node[inner]
            right = x[inner, feature[at]] >= value[at]
            node[inner] = child[at] + right
        depth += extra[node]
    return np.power(2.0, -depth / len(forest.trees) / float(path_norm(forest.size)))


def fit_forest(rows: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.05, fit_rows: int = 20_000, seed: int = 42) -> Forest:
    """An isolation forest on a bounded sample of about ``fit_rows`` rows, drawn by a hash of their ids."""
    total = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("flow_id"), F.lit(1 << 20)) / float(1 << 20) < min(1.0, fit_rows / max(total, 1)))
    x = np.array(drawn.select("features").toPandas()["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    grown = [_tree(x[rng.choice(len(x), size, replace=False)], limit, rng) for _ in range(trees)] if size > 1 else []
    forest = Forest(grown, size)
    return Forest(grown, size, float(np.quantile(_scores(forest, x), 1 - contamination))) if grown else forest


def forest_score(feature_array: Column, forest: Forest) -> Column:
    """Anomaly score from 0 to 1."""

    @F.pandas_udf("double")
    def run(arrays: pd.Series) -> pd.Series:
        if not forest.trees or not len(arrays):
            return pd.Series(np.zeros(len(arrays)))
        return pd.Series(_scores(forest, np.array(arrays.tolist(), dtype=float)))

    return run(feature_array)
