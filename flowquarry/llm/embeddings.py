"""Embedding near-duplicates: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import broadcast_if_small, small_batches, stored
from flowquarry.llm.components import connected_components

#: Vectors in a block, about: a product of two blocks stays within some MB.
BLOCK_ROWS = 1024
#: Cells: so many at least and at most, and so many parts of a cell that is larger than a block.
LEAST_CELLS, MAX_CELLS, PARTS = 4, 1024, 16
#: Bytes of vectors in a tile of blocks, about: a task holds two tiles.
TILE_BYTES = 16 << 20
#: Slack for rounding in angles.
SLACK = 1e-6


def spherical_k_means(vectors: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centroids of unit vectors by mean direction."""
    rng = np.random.default_rng(seed)
    centers = vectors[rng.choice(len(vectors), size=min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        home = (vectors @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centers)
    return centers


def parts_of(vectors: np.ndarray, centers: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and within it the part whose direction is nearest to the way from the cell's center."""
    cell = (vectors @ centers.T).argmax(axis=1)
    return cell, ((vectors - centers[cell]) @ parts.T).argmax(axis=1)


def fit_cells(vectors: np.ndarray, cells: int, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of cells, and of the ways from them to their vectors, which all cells share."""
    centers = spherical_k_means(vectors, cells)
    ways = vectors - centers[(vectors @ centers.T).argmax(axis=1)]
    length = np.linalg.norm(ways, axis=1, keepdims=True)
    ways = (ways / np.maximum(length, 1e-12))[length[:, 0] > 1e-9]
    return centers, spherical_k_means(ways, parts) if len(ways) else centers[:1]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is first scaled by a power of two, which is exact, so that no square is too large or too small."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def smallest_linked(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest node of its component, by the links between ``left`` and ``right``."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def packed(vectors: np.ndarray) -> bytes:
    """The rows as bytes: as single floats where that loses nothing, else as doubles."""
    with np.errstate(over="ignore", under="ignore"):
        single = vectors.astype("<f4")
    return (single if (single == vectors).all() else np.ascontiguousarray(vectors, "<f8")).tobytes()


def unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    """The unit vectors of rows that :func:`packed` made."""
    return unit(np.frombuffer(data, f"<f{len(data) // (rows * width)}").reshape(rows, width).astype("f8"))


def _to_block(group: pd.DataFrame) -> pd.DataFrame:
    """One block: its vectors as bytes, and a cap, by center and radius, that holds them all."""
    given = np.stack(group["v"].to_numpy())
    vectors = unit(given)
    center = vectors.sum(axis=0)
    length = np.linalg.norm(center)
    center = center / length if length > 1e-9 else vectors[0]
    radius = float(np.arccos(np.clip(vectors @ center, -1, 1)).max())
    first = group.iloc[0]
    return pd.DataFrame(
        {
            "label": [first["label"]],
            "d": [first["d"]],
            "cell": [first["cell"]],
            "part": [first["part"]],
            "ids": [group["class_id"].tolist()],
            "counts": [group["n"].tolist()],
            "vectors": [packed(given)],
            "center": [center.tolist()],
            "radius": [radius],
        }
    )


def angle(a: Column, b: Column) -> Column:
    """The angle between two unit vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def near_cells(caps: DataFrame, widest: float) -> DataFrame:
    """Rows ``(label, d, cell_a, cell_b)``, cell_a <= cell_b, of cells that may hold vectors within the angle ``widest``.

    ``caps(label, d, cell, center, radius)`` are the blocks'. A cell reaches from one of its blocks' centers as
    far as its farthest block does. A label has ``MAX_CELLS`` cells at most for each length of vectors.
    """
    homes = stored(caps.groupBy("label", "d", "cell").agg(F.min("center").alias("home")), "cell-homes")
    reach = F.max(angle(F.col("home"), F.col("center")) + F.col("radius")).alias("reach")
    cells = stored(caps.join(homes, ["label", "d", "cell"]).groupBy("label", "d", "cell", "home").agg(reach), "cell-caps")
    one, two = (cells.select("label", "d", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "reach", "home")]) for s in "ab")
    apart = angle(F.col("home_a"), F.col("home_b")) - F.col("reach_a") - F.col("reach_b")
    pairs = one.join(two, ["label", "d"]).where((F.col("cell_a") <= F.col("cell_b")) & (apart <= widest))
    return pairs.select("label", "d", "cell_a", "cell_b")


def tiles_of(blocks: DataFrame, tile_bytes: int) -> DataFrame:
    """Rows ``(block, tile)``: blocks of a label in the order of their cells, up to about ``tile_bytes`` of vectors in a tile.

    ``blocks(label, d, cell, part, block, bytes)`` has a row for some hundred vectors, and none of them.
    """
    before = F.sum("bytes").over(Window.partitionBy("label", "d").orderBy("cell", "part", "block")) - F.col("bytes")
    numbered = blocks.withColumn("nth", F.floor(before / tile_bytes))
    return numbered.select("block", F.min("block").over(Window.partitionBy("label", "d", "nth")).alias("tile"))


def _links(a, b, threshold: float) -> Iterator[pd.DataFrame]:
    """Links between two blocks, or within one: counts of links, and a few links that keep components whole."""
    (block_a, ids_a, counts_a, left_vectors), (block_b, ids_b, counts_b, right_vectors) = a, b
    product = left_vectors @ right_vectors.T
    if block_a == block_b:
        np.fill_diagonal(product, -2)
    if not product.size or product.max() < threshold:
        return
    left, right = np.nonzero(product >= threshold)
    sums = np.zeros(len(ids_a), np.int64)
    np.add.at(sums, left, counts_b[right])
    yield pd.DataFrame({"a": ids_a, "b": None, "links": sums})
    ids = ids_a
    if block_a != block_b:
        sums = np.zeros(len(ids_b), np.int64)
        np.add.at(sums, right, counts_a[left])
        yield pd.DataFrame({"a": ids_b, "b": None, "links": sums})
        ids, right = np.concatenate([ids_a, ids_b]), right + len(ids_a)
    label = smallest_linked(len(ids), left, right)
    yield pd.DataFrame({"a": ids, "b": ids[label], "links": None}).loc[label != np.arange(len(ids))]


def _compare(threshold: float, widest: float):
    """Compares the blocks of two tiles, or of one, wherever their caps do not rule out a link."""

    def read(row) -> tuple:
        ids = np.asarray(row.ids, np.int64)
        return row.block, ids, np.asarray(row.counts, np.int64), unpacked(row.vectors, len(ids), row.d)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = [list(group[group["tile"] == group[t].iloc[0]].itertuples(index=False)) for t in ("tile_a", "tile_b")]
        same = group["tile_a"].iloc[0] == group["tile_b"].iloc[0]
        centers, radii = np.array([row.center for row in sides[1]]), np.array([row.radius for row in sides[1]])
        parts = [pd.DataFrame({"a": [], "b": [], "links": []}, dtype="Int64")]
        for row in sides[0]:
            apart = np.arccos(np.clip(centers @ np.asarray(row.center), -1, 1)) - radii - row.radius
            a = read(row)
            for k in np.nonzero(apart <= widest)[0]:
                if not same or row.block <= sides[1][k].block:
                    found = [p.astype("Int64") for p in _links(a, read(sides[1][k]), threshold)]
                    parts += [p[p["b"].notna() | (p["links"] > 0)] for p in found]
        return pd.concat(parts, ignore_index=True)

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.93, sample_rows: int = 20_000, block_rows: int = BLOCK_ROWS, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` per row of ``rows(vec_id, embedding, label, ...)``.

    Vectors link when their labels are equal and not null, their lengths are equal, and their cosine in
    double precision is at least ``threshold``. Equal vectors are made one class first, so a vector
    repeated any number of times costs one. Classes get their home cell from centroids fitted on a bounded
    sample of about ``sample_rows``; a label's cell of more than ``block_rows`` is cut into ``PARTS`` by direction
    from its centroid, and what is still larger into even blocks. Two blocks are compared unless the triangle inequality of angles, over the centers and radii of their cells
    and then their own, rules out every link, so no link is lost: products run within cells and between
    cells that lie near enough. A label's blocks are dealt to tiles of ``tile_bytes``, and a task gets the blocks
    of two tiles that meet, each once: a vector travels once for each tile that its own meets.
    A product yields counts and a few links that keep components whole, never pairs. What is kept of each
    group is the vector with the smallest id.

    A vector that is null, empty, zero or holds null or non-finite components, or whose label is null,
    has no links and is its own component. Repeated rows are linked to each other; a null vec_id never
    names a component unless all members are null. Other columns are not read. An empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    small_batches(spark)
    base = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    good = usable(F.col("v")) & F.col("label").isNotNull()
    fine = base.where(good)
    grouped = fine.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    classes = stored(grouped.select("*", F.size("v").alias("d"), F.monotonically_increasing_id().alias("class_id")), "vector-classes")
    spaces = classes.groupBy("d").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).orderBy(F.desc("n"), "d").limit(1).collect()
    main, total, labels = spaces[0] if spaces else (0, 0, 1)
    cells = int(min(MAX_CELLS, max(LEAST_CELLS, total // (labels * block_rows))))
    drawn = F.pmod(F.xxhash64("class_id"), F.lit(1 << 20)) / float(1 << 20) < min(1.0, sample_rows / max(total, 1))
    sample = classes.where((F.col("d") == main) & drawn).select("v").toPandas()["v"]
    vectors = np.stack(sample.to_numpy()) if len(sample) else np.ones((1, max(main, 1)))
    centers, ways = fit_cells(unit(vectors), cells)

    @F.pandas_udf("cell int, way int")
    def home(v: pd.Series) -> pd.DataFrame:
        cell, way = parts_of(unit(np.stack(v.to_numpy())), centers, ways)
        return pd.DataFrame({"cell": cell, "way": way}, index=v.index).astype("int32")

    usual = F.col("d") == main
    found = home(F.when(usual, F.col("v")).otherwise(F.array_repeat(F.lit(1.0), max(main, 1))))
    cell = [F.when(usual, F.col("at")[c]).otherwise(F.lit(-1)).alias(c) for c in ("cell", "way")]
    placed = stored(classes.withColumn("at", found).select(*classes.columns, *cell), "vector-cells")
    sizes = placed.groupBy("label", "d", "cell", "way").agg(F.count("*").alias("of_way"))
    sizes = sizes.withColumn("of_cell", F.sum("of_way").over(Window.partitionBy("label", "d", "cell")))
    dealt = placed.join(broadcast_if_small(stored(sizes, "cell-sizes"), 100_000), ["label", "d", "cell", "way"])
    piece = F.pmod(F.xxhash64("class_id"), F.ceil(F.col("of_way") / block_rows))
    part = F.when(F.col("of_cell") > block_rows, F.col("way").cast("long") * (1 << 32) + piece).otherwise(F.lit(-1).cast("long"))
    dealt = dealt.withColumn("part", part).drop("way", "of_way", "of_cell")
    kind = rows.schema["label"].dataType.simpleString()
    shape = f"label {kind}, d int, cell int, part long, ids array<long>, counts array<long>, vectors binary, center array<double>, radius double"
    blocks = stored(
        dealt.groupBy("label", "d", "cell", "part").applyInPandas(_to_block, shape).withColumn("block", F.monotonically_increasing_id()), "vector-blocks"
    )
    widest = float(np.arccos(threshold)) + SLACK
    caps = blocks.select("label", "d", "cell", "block", "center", "radius")
    one, two = (caps.select("label", "d", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "block", "center", "radius")]) for s in "ab")
    together = one.join(stored(near_cells(caps, widest), "near-cells"), ["label", "d", "cell_a"]).join(two, ["label", "d", "cell_b"])
    once = (F.col("cell_a") < F.col("cell_b")) | (F.col("block_a") <= F.col("block_b"))
    apart = angle(F.col("center_a"), F.col("center_b")) - F.col("radius_a") - F.col("radius_b")
    near = together.where(once & (apart <= widest))
    pairs = stored(near.select("block_a", "block_b"), "block-pairs")
    tiles = stored(tiles_of(blocks.select("label", "d", "cell", "part", "block", F.octet_length("vectors").cast("long").alias("bytes")), tile_bytes), "block-tiles")
    for side in "ab":
        pairs = pairs.join(broadcast_if_small(tiles.select(*[F.col(c).alias(f"{c}_{side}") for c in ("block", "tile")]), 100_000), f"block_{side}")
    ordered = [f("tile_a", "tile_b").alias(t) for f, t in ((F.least, "tile_a"), (F.greatest, "tile_b"))]
    ends = F.explode(F.array(*[F.struct(F.col(f"block_{s}").alias("block"), F.col(f"tile_{s}").alias("tile")) for s in "ab"])).alias("end")
    sent = stored(pairs.select(*ordered, ends).select("tile_a", "tile_b", "end.*").distinct(), "sent-blocks")
    body = blocks.select("block", "d", "ids", "counts", "vectors", "center", "radius")
    product = body.join(broadcast_if_small(sent, 1_000_000), "block").groupBy("tile_a", "tile_b")
    found = stored(product.applyInPandas(_compare(threshold, widest), "a long, b long, links long"), "vector-links")
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "class_id")
    counts = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    rooted = stored(
        classes.select("class_id", "label", "v", "n", "first_id")
        .join(roots, "class_id", "left")
        .join(counts, "class_id", "left")
        .select("label", "v", "first_id", F.coalesce("component", "class_id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "vector-roots",
    )
    names = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "vector-names")
    named = stored(rooted.join(names, "root").select("label", "v", "n_links", "component_id"), "vector-named")
    linked = fine.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = base.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(threshold: float = 0.93) -> str:
    """The same rows from SQL, by all pairs of a label."""
    return (
        "with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), "
        "p as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id "
        f"where list_cosine_similarity(x.e, y.e) >= {threshold}), "
        "r(vec_id, root) as (select vec_id, vec_id from v union select p.b, r.root from r join p on r.vec_id = p.a), "
        "c as (select vec_id, min(root) as component_id from r group by 1), "
        "n as (select a, count(*) as n_links from p group by 1) "
        "select c.vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, c.vec_id = component_id as kept "
        "from c left join n on n.a = c.vec_id"
    )
