"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import broadcast_if_small, small_batches, stored
from flowquarry.llm.components import connected_components

BITS = 64
#: The first reference fingerprint; any constant serves.
BASE_PIVOT = 0x9E3779B97F4A7C15
GROUPS = 4
GROUP_BITS = BITS // GROUPS
#: Buckets up to this size compare their members pairwise.
SMALL_BUCKET = 48
#: Shingles counted at once, which bounds the bit matrix of a very long text.
CHUNK = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def walsh_rows(bits: int) -> list[int]:
    """The Walsh functions of ``bits`` points as masks: row j has bit i where popcount(i & j) is even."""
    return [sum(1 << i for i in range(bits) if (i & j).bit_count() % 2 == 0) for j in range(bits)]


def pivot_groups() -> list[list[int]]:
    """Reference fingerprints by group. Those of a group differ from BASE_PIVOT within its own bits only."""
    return [[BASE_PIVOT ^ (row << (g * GROUP_BITS)) for row in walsh_rows(GROUP_BITS)] for g in range(GROUPS)]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a whole text as an unsigned 64-bit number; 0 for a null text or one without words.

    Bytes A-Z are lower-cased; words are runs of bytes other than ASCII white space; shingles join
    ``shingle`` words by a space, or all words where there are fewer, and count as often as they occur.
    A bit is set where over half of the shingles' XXH64 values have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), "<u8", len(grams)))


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def as_number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set where over half of the hashes have them."""
    return as_number(bits_set(hashes) * 2 > len(hashes))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [signed(fingerprint(text)) for text in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row ``(doc_id, row_key, fp)`` per document, fp as a signed long; row_key is a hash of id and text."""
    small_batches(docs.sparkSession)
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return ids.mapInArrow(_fingerprints, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, row_key long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fp: Column) -> list[Column]:
    """Per group, an array of distances to the group's references, less the distance to BASE_PIVOT.

    These come from Hamming distances to whole reference fingerprints alone. The difference to the base
    leaves out what all groups' other bits add, so two fingerprints that agree in a group's bits have
    the same coordinates there.
    """
    base = distance(fp, F.lit(signed(BASE_PIVOT)))
    return [F.array(*[distance(fp, F.lit(signed(p))) - base for p in group]) for group in pivot_groups()]


def coordinate_gap(fp_a: Column, fp_b: Column) -> Column:
    """The largest difference of the two rows' distances to a reference. It is never more than their own distance."""
    pivots = [BASE_PIVOT, *[p for group in pivot_groups() for p in group]]
    return F.greatest(*[F.abs(distance(fp_a, F.lit(signed(p))) - distance(fp_b, F.lit(signed(p)))) for p in pivots])


def verified(pairs: DataFrame, max_distance: int, a: str = "a", b: str = "b") -> DataFrame:
    """Candidate pairs less those that a pivot coordinate discards, and of the survivors those within ``max_distance``."""
    left, right = F.col(a), F.col(b)
    return pairs.where(coordinate_gap(left, right) <= max_distance).where(distance(left, right) <= max_distance)


def links(fps: DataFrame, max_distance: int = 2, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints of ``fps(fp)`` at ``max_distance`` (at most 2) or less.

    At most two of the four pivot groups can differ within such a pair, so it shares its coordinates in
    two whole groups: those coordinates are the bucket key, six per fingerprint. A bucket up to
    ``small_bucket`` members offers its pairs as candidates. In a larger one, as a big family of near copies
    makes, each member is listed under itself and each fingerprint one bit away in the two open groups;
    members within two bits share such a neighbour, and each is a candidate with the neighbour's smallest
    member. All candidates are discarded when any pivot coordinate differs by more than ``max_distance``, and
    the rest are verified. So every component is whole, and the work of a bucket grows with its members alone.
    """
    if not 0 <= max_distance <= 2:
        raise ValueError("max_distance must be 0, 1 or 2")
    if max_distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    coordinates = pivot_table(F.col("fp"))
    keys = [
        F.struct(F.lit(n).alias("pair"), F.xxhash64(F.lit(n), coordinates[g], coordinates[h]).alias("bucket"))
        for n, (g, h) in enumerate(combinations(range(GROUPS), 2))
    ]
    members = stored(
        fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.pair", "key.bucket"), "pivot-buckets"
    )
    sizes = stored(members.groupBy("pair", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "pivot-sizes")
    sized = stored(members.join(sizes, ["pair", "bucket"]), "pivot-sized")
    few = sized.where(F.col("n") <= small_bucket)
    left = few.select("pair", "bucket", F.col("fp").alias("a"))
    right = few.select("pair", "bucket", F.col("fp").alias("b"))
    pairs = (
        left.join(right, ["pair", "bucket"])
        .where(F.col("a") < F.col("b"))
        .select("a", "b")
    )
    open_bits = [
        [b for g in range(GROUPS) if g not in pair for b in range(g * GROUP_BITS, (g + 1) * GROUP_BITS)]
        for pair in combinations(range(GROUPS), 2)
    ]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)) for b in bits]) for bits in open_bits])
    if max_distance == 1:
        many = sized.where(F.col("n") > small_bucket).select("fp", F.explode(F.element_at(flips, F.col("pair") + 1)).alias("flip"))
        near = many.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("b"))
        return verified(pairs.union(near.join(fps.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")), max_distance)
    many = sized.where(F.col("n") > small_bucket).select("fp", F.explode(F.element_at(flips, F.col("pair") + 1)).alias("flip"))
    hubs = many.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")).agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    shared = stored(hubs.where("a < z").select("hub", "a"), "pivot-hubs")
    near = many.select(F.col("fp").alias("b"), F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    return verified(pairs.union(near.join(shared, "hub").where("a < b").select("a", "b")), max_distance)


def near_duplicates(docs: DataFrame, max_distance: int = 2) -> DataFrame:
    """One row ``(doc_id, row_key, fp, root, component_id)`` per document of ``docs(doc_id, text, ...)``.

    ``root`` is the component's smallest fingerprint, ``component_id`` the smallest doc_id reachable over links of ``max_distance`` bits or less, itself
    included. Documents without words have fingerprint 0 and link like any other. Repeated rows stay
    repeated; a null doc_id never names a component unless all its members are null; other columns
    are not read. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp")), "rooted")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.select("fp", "root").join(names, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, max_distance: int = 2, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest doc_id, nulls last, ties by a hash.

    Texts stay where they are, but for rows that are repeated whole, which meet to be made one.
    """
    return keep_first(docs, near_duplicates(docs, max_distance), broadcast_rows)


def keep_first(docs: DataFrame, groups: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each group of ``groups(doc_id, row_key, root)``, as :func:`keep_one` chooses it.

    Of rows with the same id and text the one stays whose columns, written as JSON, come first.
    """
    rows = stored(groups, "near-duplicates")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    first = rows.groupBy("root").agg(F.min(order).alias("kept")).select("root", "kept.row_key").withColumnRenamed("row_key", "kept_key")
    held = rows.join(stored(first, "near-duplicate-keepers"), "root")
    lost = stored(held.where("row_key <> kept_key").select("row_key", F.col("doc_id").alias("lost_id")).distinct(), "near-duplicates-lost")
    same = held.where("row_key = kept_key").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key")
    repeated = stored(same, "repeated-rows")
    keyed = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"))
    at = (keyed.row_key == lost.row_key) & keyed["doc.doc_id"].eqNullSafe(lost.lost_id)
    kept = keyed.join(broadcast_if_small(lost, broadcast_rows), at, "left_anti")
    if not repeated.limit(1).count():
        return kept.select("doc.*")
    small = broadcast_if_small(repeated, broadcast_rows)
    once = kept.join(small, "row_key", "left_anti").select("doc.*")
    many = kept.join(small, "row_key", "left_semi").groupBy("row_key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return once.union(many.select("doc.*"))


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
