"""Roles, scores and identities of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import is_internal

#: What an alert adds to a host's score by severity, how a role weighs, and the half-life.
SEVERITY_WEIGHT = {"LOW": 5.0, "MEDIUM": 15.0, "HIGH": 35.0, "CRITICAL": 60.0}
ROLE_WEIGHT = {"DOMAIN_CONTROLLER": 2.5, "DATABASE_SERVER": 2.0, "JUMP_HOST": 1.8, "WEB_SERVER": 1.5, "WORKSTATION": 1.0, "IOT_DEVICE": 0.8, "UNKNOWN": 1.0}
HALF_LIFE_S = 3600
MANAGED_PORTS = (445, 135, 5985, 22)


def lookup(value: Column, table: dict, default: object) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default)


def roles(flows: DataFrame) -> DataFrame:
    """``(ip, role)`` of every internal host, by who connects to its ports and whom it manages."""
    none = F.lit(None).cast("string")
    managed = F.when(F.col("dst_port").isin(*MANAGED_PORTS) & is_internal(F.col("dst_ip")), F.col("dst_ip"))
    served = F.struct(F.col("dst_ip").alias("ip"), F.col("src_ip").alias("client"), F.col("dst_port").alias("port"), none.alias("managed"))
    ran = F.struct(F.col("src_ip").alias("ip"), none.alias("client"), F.lit(None).cast("int").alias("port"), managed.alias("managed"))
    ends = F.explode(F.array(served, ran))
    seen = flows.select("src_ip", "dst_ip", "dst_port").distinct().select(ends.alias("e")).select("e.*").where(is_internal(F.col("ip")))
    clients = lambda *ports: [F.count_distinct(F.when(F.col("port") == p, F.col("client"))).alias(f"c{p}") for p in ports]
    n = seen.groupBy("ip").agg(*clients(53, 445, 88, 389, 80, 443, 3306, 5432), F.count_distinct("managed").alias("managed"))
    c = lambda p: F.col(f"c{p}")
    role = (
        F.when((c(88) >= 3) | (c(389) >= 3) | ((c(445) >= 5) & ((c(88) > 0) | (c(389) > 0))), "INFRASTRUCTURE_DC")
        .when(c(53) >= 4, "INFRASTRUCTURE_DNS")
        .when((F.col("managed") >= 5) & (c(445) < 2), "ADMIN_MANAGEMENT")
        .when((c(80) + c(443) >= 4) | (c(3306) + c(5432) >= 3), "INTERNAL_SERVER")
        .otherwise("WORKSTATION")
    )
    return n.select("ip", role.alias("role"))


def threat_scores(alerts: DataFrame, as_of_us: int, host_roles: DataFrame | None = None) -> DataFrame:
    """``(ip, role, score, alerts)``: each alert's weight halves every hour up to ``as_of_us``; at most 100."""
    age_s = (F.lit(as_of_us) - F.col("t_us")) / 1e6
    raw = F.sum(lookup(F.col("severity"), SEVERITY_WEIGHT, 0.0) * F.pow(F.lit(2.0), -age_s / HALF_LIFE_S))
    sums = alerts.where(F.col("t_us") <= as_of_us).groupBy(F.col("src_ip").alias("ip")).agg(raw.alias("raw"), F.count("*").alias("alerts"))
    if host_roles is not None:
        sums = sums.join(host_roles, "ip", "left")
    role = F.coalesce("role", F.lit("UNKNOWN")) if host_roles is not None else F.lit("UNKNOWN")
    named = sums.withColumn("role", role)
    return named.select("ip", "role", F.round(F.least(F.lit(100.0), F.col("raw") * lookup(F.col("role"), ROLE_WEIGHT, 1.0)), 2).alias("score"), "alerts")


def threat_history(alerts: DataFrame, times_us: list[int], host_roles: DataFrame | None = None) -> DataFrame:
    """:func:`threat_scores` as of each of some times, with the time as ``as_of_us``, from one pass over the alerts."""
    at = alerts.withColumn("as_of_us", F.explode(F.array(*[F.lit(t) for t in times_us]))).where("t_us <= as_of_us")
    age_s = (F.col("as_of_us") - F.col("t_us")) / 1e6
    raw = F.sum(lookup(F.col("severity"), SEVERITY_WEIGHT, 0.0) * F.pow(F.lit(2.0), -age_s / HALF_LIFE_S))
    sums = at.groupBy(F.col("src_ip").alias("ip"), "as_of_us").agg(raw.alias("raw"), F.count("*").alias("alerts"))
    if host_roles is not None:
        sums = sums.join(host_roles, "ip", "left")
    role = F.coalesce("role", F.lit("UNKNOWN")) if host_roles is not None else F.lit("UNKNOWN")
    named = sums.withColumn("role", role)
    score = F.round(F.least(F.lit(100.0), F.col("raw") * lookup(F.col("role"), ROLE_WEIGHT, 1.0)), 2)
    return named.select("ip", "as_of_us", "role", score.alias("score"), "alerts")


def ranking(scores: DataFrame, role: str | None = None, least: float = 0.0, limit: int = 50) -> DataFrame:
    out = scores.where(F.col("score") >= least)
    return (out if role is None else out.where(F.col("role") == role)).orderBy(F.desc("score"), "ip").limit(limit)


def normal_mac(mac: Column) -> Column:
    return F.replace(F.lower(F.trim(mac)), F.lit("-"), F.lit(":"))


def lease_intervals(leases: DataFrame) -> DataFrame:
    """``leases(ip, mac, hostname, t_us)`` with the time each lease ends: at the next one of its address."""
    w = Window.partitionBy("ip").orderBy("t_us", "mac")
    return leases.select("ip", normal_mac(F.col("mac")).alias("mac"), F.lower("hostname").alias("hostname"), F.col("t_us").alias("from_us"), F.lead("t_us").over(w).alias("until_us"))


def identities(rows: DataFrame, leases: DataFrame) -> DataFrame:
    """``rows(flow_id, src_ip, t_us)`` with the MAC and host name that held the address at that time.

    An as-of join in one sort: leases and rows of an address are put in time order together and each row
    takes the last lease before it, so no interval is compared with every row.
    """
    lease = F.struct(normal_mac(F.col("mac")).alias("mac"), F.lower("hostname").alias("hostname"))
    both = leases.select(F.col("ip"), "t_us", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("flow_id"), lease.alias("lease")).unionByName(
        rows.select(F.col("src_ip").alias("ip"), "t_us", F.lit(1).alias("kind"), "flow_id", F.lit(None).cast("struct<mac:string,hostname:string>").alias("lease"))
    )
    w = Window.partitionBy("ip").orderBy("t_us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last", F.last("lease", ignorenulls=True).over(w)).where("kind = 1")
    return found.select("flow_id", "ip", "t_us", "last.mac", "last.hostname")


def entity_key(mac: Column, hostname: Column, ip: Column) -> Column:
    """What names an entity: its MAC, else its host name, else its address."""
    return F.coalesce(F.concat(F.lit("mac:"), normal_mac(mac)), F.concat(F.lit("host:"), F.lower(hostname)), F.concat(F.lit("ip:"), ip))


def entities(sightings: DataFrame) -> DataFrame:
    """One row per entity of ``sightings(mac, hostname, ip, t_us)``: its key, what it was last known by, and when it was seen.

    A sighting belongs to its MAC, else to its host name, else to its address. A host name or address that
    was once seen with a MAC stands for the entity of the MAC it was last seen with.
    """
    rows = sightings.select(normal_mac(F.col("mac")).alias("mac"), F.lower("hostname").alias("hostname"), "ip", "t_us")
    known = rows.where("mac is not null")
    last = lambda c, what: known.where(F.col(c).isNotNull()).groupBy(c).agg(F.max_by("mac", F.struct("t_us", "mac")).alias(what))
    joined = rows.join(last("hostname", "host_mac"), "hostname", "left").join(last("ip", "ip_mac"), "ip", "left")
    mac = F.coalesce("mac", "host_mac", F.when(F.col("hostname").isNull(), F.col("ip_mac")))
    keyed = joined.withColumn("entity", entity_key(mac, F.col("hostname"), F.col("ip")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("t_us", c))).alias(c)
    return keyed.groupBy("entity").agg(latest("ip"), latest("hostname"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("sightings"))
