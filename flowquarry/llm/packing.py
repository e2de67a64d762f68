"""Best-fit packing into bins of several permitted sequence lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.mixing import n_tokens

SIZES = (512, 1024, 2048, 4096)
#: Documents that one task packs, about. Larger shards pack hardly better.
SHARD_DOCS = 50_000
RESULT = "piece int, n_tokens long, bin_id long, bin_size int, start int, doc_start long, row_key long"


def cost(size: int, overhead: float = 32.0, attention: float = 1 / 65536) -> float:
    """What a sequence of this length costs to train on: its tokens, a fixed part, and attention's square."""
    return size + overhead + attention * size * size


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(index, piece, length, bin, bin size, start)`` for all pieces of the given lengths.

    A length over the largest size is cut into pieces of that size and a rest. Pieces go by falling
    length, ties in the given order, into the open bin with the least room that suffices. Where none
    does, a bin opens at the size of least net cost: its cost less what the tokens still to come may fill
    of it, at the best price per token. At last each bin shrinks to the least size that holds it.
    """
    sizes = tuple(sorted(sizes))
    largest = sizes[-1]
    price = min(cost(s) / s for s in sizes)
    pieces = [(largest, i, k) for i, n in enumerate(lengths) for k in range(n // largest)]
    pieces += [(n % largest, i, n // largest) for i, n in enumerate(lengths) if n % largest]
    pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    ahead = sum(n for n, _, _ in pieces)
    room: list[tuple[int, int]] = []  # of open bins, least first
    held: list[int] = []
    opened: list[int] = []
    placed = []
    for n, i, k in pieces:
        ahead -= n
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: (cost(s) - price * min(s - n, ahead), s))
            free, b = size, len(held)
            held.append(0)
            opened.append(size)
        placed.append((i, k, n, b, held[b]))
        held[b] += n
        if free > n:
            insort(room, (free - n, b))
    final = [next(s for s in sizes if s >= h) for h in held]
    return [(i, k, n, b, final[b], start) for i, k, n, b, start in placed]


def best_fit(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Rows ``(doc_id, piece, n_tokens, bin_id, bin_size, start, doc_start, row_key)`` that place all tokens of ``docs(doc_id, text, ...)``.

    A row puts ``n_tokens`` tokens of a document, from its ``doc_start``-th on, at ``start`` of a bin; ``row_key`` is a
    hash of id and text, so :func:`with_text` and :func:`sequences` can fill the bins.

    Rows are dealt out in turn to shards of about ``shard_docs``, which no key can make uneven, and each
    shard is packed by itself. Only ids and lengths are moved. Tokens are words between white space. A
    null or empty text, or one without tokens, has one row with 0 tokens and no bin. Repeated rows are
    packed each for itself; extra columns are not read; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", n_tokens(F.col("text")).alias("n"), F.xxhash64("doc_id", "text").alias("row_key"))
    largest = max(sizes)
    shards = max(1, -(-docs.count() // shard_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not sum(map(len, parts)):
            return
        shard = pa.Table.from_batches(parts)
        shard = shard.take(pc.sort_indices(shard, [("n", "descending"), ("doc_id", "ascending")]))
        lengths = shard.column("n").to_pylist()
        base = TaskContext.get().partitionId() << 32
        rows = [(i, k, n, base + b, size, at, k * largest) for i, k, n, b, size, at in pack(lengths, sizes)]
        rows += [(i, 0, 0, None, None, None, 0) for i, n in enumerate(lengths) if n == 0]
        taken, *columns = zip(*rows, strict=True)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        ids, keys = (shard.column(c).take(pa.array(taken)).combine_chunks() for c in ("doc_id", "row_key"))
        names = ["doc_id", "piece", "n_tokens", "bin_id", "bin_size", "start", "doc_start", "row_key"]
        yield from pa.Table.from_arrays([ids, *map(pa.array, columns, kinds), keys], names=names).to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.repartition(shards).mapInArrow(run, f"doc_id {kind}, {RESULT}")


def with_text(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed``, as :func:`best_fit` makes it of ``docs``, with the tokens of each piece in ``text``, a blank between two.

    A repeated row's text is taken once for each of its placements. A piece without tokens has an empty text.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), words.alias("words")).dropDuplicates(["row_key"])
    slice_ = F.slice("words", F.col("doc_start").cast("int") + 1, F.col("n_tokens").cast("int"))
    return placed.join(texts, "row_key").select(*placed.columns, F.array_join(slice_, " ").alias("text"))


def sequences(filled: DataFrame) -> DataFrame:
    """Rows ``(bin_id, bin_size, n_tokens, text, doc_ids, starts)``: each bin's tokens in order, and where its documents begin.

    ``filled`` is that of :func:`with_text`. No bin holds more than the largest size.
    """
    parts = F.array_sort(F.collect_list(F.struct("start", "doc_id", "text")))
    bins = filled.where("bin_id is not null").groupBy("bin_id", "bin_size").agg(F.sum("n_tokens").alias("n_tokens"), parts.alias("parts"))
    return bins.select(
        "bin_id", "bin_size", "n_tokens", F.array_join(F.col("parts.text"), " ").alias("text"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("starts")
    )
