"""Small tables that hold the hard cases: nulls, empty and long texts, ties, repeats, extra columns with clashing names."""

from __future__ import annotations

import random

WORDS = "river stone garden window market silver morning paper winter bridge forest letter candle harbor music copper".split()
#: Names that the operators use inside.
CLASHING = ["row_key", "fp", "doc", "body", "found", "word", "n", "rate", "copies", "root", "target", "key", "text_", "n_tokens", "kinds", "shard", "digest"]


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_documents() -> list[tuple[int | None, str | None]]:
    """Ids and texts: distinct ones, near copies, copies, a row repeated whole, a long text, empty and null ones."""
    rows: list[tuple[int | None, str | None]] = [(i, sentence(i, 30 + i)) for i in range(1, 25)]
    rows += [(100 + i, sentence(1, 31)) for i in range(6)]
    rows += [(120, sentence(2, 32) + " harbor"), (121, sentence(3, 33).upper())]
    rows += [(7, sentence(7, 37)), (7, sentence(7, 37))]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (204, "One two"), (205, "!!! ---"), (206, None)]
    rows += [(None, sentence(400, 20)), (None, None), (300, sentence(9, 60_000))]
    return rows


def frame(spark, rows, extra: bool = True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHING if extra else []:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark, extra: bool = True):
    return frame(spark, [], extra)


def components(nodes, linked) -> dict:
    """For each node the smallest one reachable, by trying all pairs."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {n: top(n) for n in nodes}
