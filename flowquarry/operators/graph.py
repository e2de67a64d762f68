"""The host graph: edges, compromise, blast radius and patient zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.hosts import lookup
from flowquarry.sources.cut import cut, stored

#: How a role weighs in a blast radius, and what a severity adds to a host's risk.
ROLE_RISK = {"INFRASTRUCTURE_DC": 45.0, "INTERNAL_SERVER": 25.0, "ADMIN_MANAGEMENT": 25.0, "INFRASTRUCTURE_DNS": 15.0, "WORKSTATION": 5.0}
SEVERITY_RISK = {"LOW": 15.0, "MEDIUM": 40.0, "HIGH": 75.0, "CRITICAL": 100.0}
C2 = ("MALICIOUS_C2", "C2_BEACONING")


def edges(flows: DataFrame) -> DataFrame:
    return flows.groupBy("src_ip", "dst_ip").agg(
        F.sum("bytes").alias("bytes"),
        F.sum("packets").alias("packets"),
        F.count("*").alias("flows"),
        F.array_sort(F.collect_set("protocol")).alias("protocols"),
        F.array_sort(F.collect_set("dst_port")).alias("dst_ports"),
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
    )


def degrees(edge_rows: DataFrame) -> DataFrame:
    """``(ip, out_degree, in_degree)`` by distinct neighbours."""
    ends = F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_ip").alias("ip"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edge_rows.select(ends.alias("e")).groupBy("e.ip").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def compromised(alerts: DataFrame) -> DataFrame:
    """``(ip, compromised_us, risk)``: sources of alerts of MEDIUM or more, and what lateral movement reached."""
    serious = alerts.where("severity in ('MEDIUM', 'HIGH', 'CRITICAL')").withColumn("score", lookup(F.col("severity"), SEVERITY_RISK, 0.0) * F.col("confidence"))
    source, target = F.struct(F.col("src_ip").alias("ip"), "score"), F.struct(F.col("dst_ip").alias("ip"), (F.col("score") * 0.8).alias("score"))
    ends = F.when(F.col("category") == "LATERAL_MOVEMENT", F.array(source, target)).otherwise(F.array(source))
    hit = serious.select("t_us", F.explode(ends).alias("end")).select("t_us", "end.*")
    return hit.groupBy("ip").agg(F.min("t_us").alias("compromised_us"), F.round(F.max("score"), 2).alias("risk"))


def marked_edges(edge_rows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Edges with whether lateral movement or command traffic was seen on them."""
    seen = alerts.groupBy("src_ip", "dst_ip").agg(
        F.bool_or(F.col("category") == "LATERAL_MOVEMENT").alias("lateral"), F.bool_or(F.col("category").isin(*C2)).alias("c2")
    )
    joined = edge_rows.join(seen, ["src_ip", "dst_ip"], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("lateral", "c2")})


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``: the smallest node it is connected with.

    Each round a node takes the smallest name among its neighbours' and then that name's own, until none changes, so
    chains shrink by a power each round. Rounds are written to the checkpoint folder.
    """
    both = links.where("a <> b").select("a", "b")
    both = stored(both.union(both.select("b", "a")).distinct(), "graph-links")
    names = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "graph-names")
    while True:
        offers = both.join(names, both.b == names.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        better = stored(names.join(offers, "node").select("node", F.least("component", "offer").alias("component"), (F.col("offer") < F.col("component")).alias("moved")), "graph-names")
        if not better.where("moved").limit(1).count():
            return names
        own = better.select(F.col("node").alias("component"), F.col("component").alias("next"))
        names = stored(better.select("node", "component").join(own, "component").select("node", F.col("next").alias("component")), "graph-names")


def reach(edge_rows: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """``(start_ip, ip, hops)`` of every host that ``starts(start_ip)`` reach, at its least distance up to ``depth``."""
    steps = cut(edge_rows.select("src_ip", "dst_ip").distinct())
    seen = starts.select("start_ip", F.col("start_ip").alias("ip"), F.lit(0).alias("hops"))
    front = seen
    for d in range(1, depth + 1):
        fresh = front.join(steps, front.ip == steps.src_ip).select("start_ip", F.col("dst_ip").alias("ip")).distinct()
        front = cut(fresh.join(seen.select("start_ip", "ip"), ["start_ip", "ip"], "left_anti").withColumn("hops", F.lit(d)))
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def blast_radius(edge_rows: DataFrame, starts: DataFrame, roles: DataFrame, hit: DataFrame, depth: int = 3) -> DataFrame:
    """``(start_ip, reachable, critical, score, level)``: roles in reach, less with distance."""
    found = reach(edge_rows, starts, depth).join(roles, "ip", "left")
    weight = lookup(F.col("role"), ROLE_RISK, 5.0) / F.pow(F.col("hops").cast("double"), F.lit(0.75))
    sums = found.groupBy("start_ip").agg(
        F.count("*").alias("reachable"),
        F.count_if(F.col("role").isin("INFRASTRUCTURE_DC", "INTERNAL_SERVER", "ADMIN_MANAGEMENT")).alias("critical"),
        F.sum(weight).alias("weight"),
    )
    known = starts.select("start_ip").distinct().join(sums, "start_ip", "left").join(hit.select(F.col("ip").alias("start_ip"), "risk"), "start_ip", "left")
    base = F.round(F.coalesce("weight", F.lit(0.0)) / 120.0 * 100.0, 1)
    score = F.least(F.lit(100.0), F.greatest(base, F.coalesce(F.col("risk") * 0.5, F.lit(0.0))))
    level = F.when(score >= 70, "CRITICAL").when(score >= 45, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")
    zero = F.lit(0).cast("long")
    return known.select("start_ip", F.coalesce("reachable", zero).alias("reachable"), F.coalesce("critical", zero).alias("critical"), score.alias("score"), level.alias("level"))


def patient_zero(edge_rows: DataFrame, hit: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_ip, patient_zero, hops, path)``: the longest causal chain back from each target; ties by address.

    A step back is causal over an edge with lateral movement or command traffic, or from a host that was
    compromised no later than the target. A host is visited once for a target, by its least path; the
    walk ends when no target has a new host, which the number of hosts bounds.
    """
    when = hit.select(F.col("ip").alias("node"), "compromised_us")
    mine = targets.select("target_ip").join(when.select(F.col("node").alias("target_ip"), F.col("compromised_us").alias("target_us")), "target_ip", "left")
    back = edge_rows.select(F.col("dst_ip").alias("at"), F.col("src_ip").alias("node"), (F.col("lateral") | F.col("c2")).alias("direct"))
    back = cut(back.join(when, "node", "left"))
    front = mine.select("target_ip", "target_us", F.col("target_ip").alias("at"), F.array("target_ip").alias("path"))
    front = cut(front)
    seen = front.select("target_ip", F.col("at").alias("node"))
    found = front
    while front.limit(1).count():
        early = F.col("compromised_us").isNotNull() & (F.col("target_us").isNull() | (F.col("compromised_us") <= F.col("target_us")))
        step = front.join(back, "at").where(F.col("direct") | early).select("target_ip", "target_us", "node", F.concat(F.array("node"), "path").alias("path"))
        fresh = step.join(seen, ["target_ip", "node"], "left_anti").groupBy("target_ip", "target_us", "node").agg(F.min("path").alias("path"))
        front = cut(fresh.select("target_ip", "target_us", F.col("node").alias("at"), "path"))
        seen = cut(seen.unionByName(front.select("target_ip", F.col("at").alias("node"))))
        found = found.unionByName(front)
    best = found.groupBy("target_ip").agg(F.min(F.struct((-F.size("path")).alias("n"), F.col("path"))).alias("b"))
    return best.select("target_ip", F.element_at("b.path", 1).alias("patient_zero"), (F.size("b.path") - 1).alias("hops"), F.array_join("b.path", " -> ").alias("path"))


def topology(edge_rows: DataFrame, hit: DataFrame, compromised_only: bool = False) -> DataFrame:
    """Edges with whether each end is compromised; on demand only those next to a compromised host."""
    ends = hit.select("ip")
    out = (
        edge_rows.join(ends.select(F.col("ip").alias("src_ip"), F.lit(True).alias("src_hit")), "src_ip", "left")
        .join(ends.select(F.col("ip").alias("dst_ip"), F.lit(True).alias("dst_hit")), "dst_ip", "left")
        .select("src_ip", "dst_ip", "bytes", "flows", F.coalesce("src_hit", F.lit(False)).alias("src_hit"), F.coalesce("dst_hit", F.lit(False)).alias("dst_hit"))
    )
    return out.where("src_hit or dst_hit") if compromised_only else out
