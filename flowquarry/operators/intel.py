"""Matches of flows with indicators: addresses, networks, fingerprints, and a counting Bloom filter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.net import in_networks, ip_number, network
from flowquarry.operators.detect import FIRE
from flowquarry.operators.dims import table
from flowquarry.sources.cut import broadcast_if_small


def match_exact(flows: DataFrame, iocs: DataFrame) -> DataFrame:
    """Flows with an indicator at one end; the destination's wins. ``iocs(ip, family, actor, ...)`` has one row per address.

    A feed of up to a million addresses is broadcast, so flows stay where they are; a larger one is shuffled.
    """
    rest = [c for c in iocs.columns if c != "ip"]
    feed = broadcast_if_small(iocs)
    side = lambda s: feed.select(F.col("ip").alias(f"{s}_ip"), F.struct(*rest).alias(f"{s}_hit"))
    joined = flows.join(side("dst"), "dst_ip", "left").join(side("src"), "src_ip", "left").where("dst_hit is not null or src_hit is not null")
    hit = F.coalesce("dst_hit", "src_hit")
    return joined.select(*flows.columns, F.when(F.col("dst_hit").isNotNull(), "dst").otherwise("src").alias("side"), *[hit[c].alias(f"ioc_{c}") for c in rest])


def match_networks(flows: DataFrame, networks: list[tuple[str, str]]) -> DataFrame:
    """Flows whose destination, else source, lies in a network; of several the first in the list. Rows gain ``family`` and ``side``.

    A network is an equality on the leading bits of an address: for each length that occurs, both ends are
    looked up in a broadcast table, so flows are neither shuffled nor multiplied.
    """
    first: dict[tuple[int, int], tuple[int, str]] = {}
    for order, (cidr, family) in enumerate(networks):
        bits = int(cidr.partition("/")[2] or 32)
        first.setdefault((bits, network(cidr)[0] >> (32 - bits)), (order, family))
    if not first:
        return flows.where("false").select(*flows.columns, F.lit("dst").alias("side"), F.lit("").alias("family"))
    out = flows.withColumns({"n_dst": ip_number(F.col("dst_ip")), "n_src": ip_number(F.col("src_ip"))})
    hits: dict[str, list[str]] = {"dst": [], "src": []}
    for bits in sorted({b for b, _ in first}):
        rows = [(p, *hit) for (b, p), hit in first.items() if b == bits]
        known = F.broadcast(table(flows.sparkSession, rows, "prefix long, order int, family string"))
        for side in hits:
            name = f"hit_{side}_{bits}"
            hits[side].append(name)
            tries = known.select(F.col("prefix").alias("tried"), F.struct("order", "family").alias(name))
            out = out.join(tries, F.shiftright(f"n_{side}", 32 - bits) == F.col("tried"), "left").drop("tried")
    best = {s: F.array_min(F.array(*names)) for s, names in hits.items()}
    found = out.withColumns({f"best_{s}": c for s, c in best.items()}).where("best_dst is not null or best_src is not null")
    side = F.when(F.col("best_dst").isNotNull(), "dst").otherwise("src")
    return found.select(*flows.columns, side.alias("side"), F.coalesce("best_dst", "best_src")["family"].alias("family"))


def indicator_alerts(flows: DataFrame, iocs: DataFrame, networks: list[tuple[str, str]], seeds: DataFrame) -> DataFrame:
    """Fired rows of the indicator steps: the exact feed and, on a miss, networks; where both miss, the second feed.

    Of the first feed a CRITICAL indicator fires so and any other HIGH, at a confidence of 0.98. Of the second,
    ``seeds(ip, family, actor, confidence)``, one at the destination is CRITICAL and one at the source HIGH. Each
    end is tried in the first feed before the next end, and all of the first feed before the second. The planner
    broadcasts feeds whose size it knows to be small, as tables and fixed lists tell it.
    """
    marked = flows
    seed = seeds.select("ip", "confidence")
    exact = iocs.select("ip", F.col("severity").alias("level"))
    for side in ("dst", "src"):
        marked = marked.join(exact.select(F.col("ip").alias(f"{side}_ip"), F.col("level").alias(f"{side}_level")), f"{side}_ip", "left")
        marked = marked.join(seed.select(F.col("ip").alias(f"{side}_ip"), F.col("confidence").alias(f"{side}_seed")), f"{side}_ip", "left")
        inside = in_networks(F.col(f"{side}_ip"), tuple(c for c, _ in networks)) if networks else F.lit(False)
        marked = marked.withColumn(f"{side}_level", F.coalesce(f"{side}_level", F.when(inside, "HIGH")))
    level, seeded = F.coalesce("dst_level", "src_level"), F.coalesce("dst_seed", "src_seed")
    hit = marked.where(level.isNotNull() | seeded.isNotNull()).withColumn("step", F.when(level.isNotNull(), "indicator").otherwise("indicator_filter"))
    first = F.col("step") == "indicator"
    severity = F.when(first, F.when(level == "CRITICAL", "CRITICAL").otherwise("HIGH")).otherwise(F.when(F.col("dst_seed").isNotNull(), "CRITICAL").otherwise("HIGH"))
    made = {
        "detector": F.col("step"),
        "category": F.lit("MALICIOUS_C2"),
        "severity": severity,
        "confidence": F.when(first, 0.98).otherwise(seeded),
        "cooldown_s": F.lit(0.0),
        "key": F.concat_ws("|", "src_ip", "dst_ip"),
        "evidence": F.col("bytes").cast("double"),
    }
    return hit.select(*[made[c].alias(c) if c in made else F.col(c) for c in FIRE])


def match_fingerprints(flows: DataFrame, known: DataFrame, benign: tuple[str, ...]) -> DataFrame:
    """Flows with a known TLS fingerprint, JA4 before JA3, and whether its first part is a common client's."""
    kinds = [k for k in ("ja4", "ja3") if k in flows.columns]
    out = flows
    for kind in kinds:
        seen = known.where(F.col("kind") == kind).select(F.col("fingerprint").alias(kind), F.struct("family", "actor", "severity", "technique_id").alias(f"{kind}_hit"))
        out = out.join(broadcast_if_small(seen), kind, "left")
    hit = F.coalesce(*[F.col(f"{k}_hit") for k in kinds])
    common = F.coalesce(F.split_part("ja4", F.lit("_"), F.lit(1)).isin(*benign), F.lit(False))
    return out.select(*flows.columns, hit["family"].alias("family"), hit["severity"].alias("severity"), common.alias("common_client")).where("family is not null or common_client")


def bloom_shape(capacity: int, error: float) -> tuple[int, int]:
    """Counters and hashes of a Bloom filter."""
    cells = int(-capacity * math.log(error) / math.log(2) ** 2)
    return cells, max(1, int(cells / capacity * math.log(2)))


def bloom_counters(keys: DataFrame, capacity: int, error: float) -> DataFrame:
    """A counting Bloom filter of ``keys(key, n)`` as rows ``(cell, count)``; a negative n takes keys out again."""
    cells, hashes = bloom_shape(capacity, error)
    h1 = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long")
    h2 = F.conv(F.substring(F.sha1(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long")
    at = F.explode(F.array_distinct(F.array(*[(h1 + i * h2) % cells for i in range(hashes)])))
    summed = keys.select(at.alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("count"))
    return summed.select("cell", F.least("count", F.lit(255)).alias("count")).where("count > 0")


def bloom_contains(counters: DataFrame, keys: DataFrame, capacity: int, error: float) -> DataFrame:
    """``keys(key)`` with whether the filter may hold them."""
    cells, hashes = bloom_shape(capacity, error)
    h1 = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long")
    h2 = F.conv(F.substring(F.sha1(F.col("key").cast("binary")), 1, 8), 16, 10).cast("long")
    at = keys.select("key", F.explode(F.array_distinct(F.array(*[(h1 + i * h2) % cells for i in range(hashes)]))).alias("cell"))
    return at.join(counters, "cell", "left").groupBy("key").agg(F.bool_and(F.col("count").isNotNull()).alias("contained"))


def edited(iocs: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """An indicator table with rows of ``added`` in place of those with the same address, less the addresses of ``removed(ip)``."""
    out = iocs
    if added is not None:
        out = out.join(added.select("ip"), "ip", "left_anti").select(*iocs.columns).unionByName(added)
    return out if removed is None else out.join(removed.select("ip"), "ip", "left_anti").select(*iocs.columns)
