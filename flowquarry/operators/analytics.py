"""Filtered scans, listings and aggregations over flows and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import protocol_name
from flowquarry.operators.blocks import quiet_segments

EQUAL = ("src_ip", "dst_ip", "dst_port", "protocol", "ja4")


def query(flows: DataFrame, filters: Mapping[str, object] | None = None, columns: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
    """Rows that meet all filters, oldest first. Unknown columns and filters of None are ignored.

    Filters: equality on src_ip, dst_ip, dst_port, protocol and ja4; ``min_bytes``; ``start_time`` and
    ``end_time``, both inclusive. All of them reach the Parquet scan.
    """
    filters = {k: v for k, v in (filters or {}).items() if v is not None}
    out = flows
    for name in EQUAL:
        if name in filters:
            out = out.where(F.col(name) == F.lit(filters[name]))
    if "min_bytes" in filters:
        out = out.where(F.col("bytes") >= F.lit(filters["min_bytes"]))
    if "start_time" in filters:
        out = out.where(F.col("ts") >= F.lit(filters["start_time"]).cast("timestamp"))
    if "end_time" in filters:
        out = out.where(F.col("ts") <= F.lit(filters["end_time"]).cast("timestamp"))
    kept = [c for c in (columns or flows.columns) if c in flows.columns]
    return out.orderBy("t_us", "flow_id").limit(limit).select(*kept)


def search(flows: DataFrame, tenant: str = "*", src: str | None = None, dst: str | None = None, port: int | None = None, protocol: int | None = None, limit: int = 50) -> DataFrame:
    """Newest flows first; ``port`` may be either end's; tenant ``*`` sees all."""
    out = flows if tenant == "*" else flows.where(F.col("tenant_id") == tenant)
    for name, value in (("src_ip", src), ("dst_ip", dst), ("protocol", protocol)):
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    if port is not None:
        out = out.where((F.col("src_port") == port) | (F.col("dst_port") == port))
    return out.orderBy(F.desc("t_us"), F.desc("flow_id")).limit(max(1, min(200, limit)))


def list_alerts(alerts: DataFrame, severity: str | None = None, category: str | None = None, src: str | None = None, status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of alerts, newest first, with the number of all that match."""
    out = alerts
    for name, value in (("severity", severity), ("category", category), ("src_ip", src), ("status", status)):
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    total = out.agg(F.count("*").alias("total"))
    page = out.orderBy(F.desc("t_us"), F.desc("alert_id")).offset(offset).limit(min(500, limit))
    return page.crossJoin(F.broadcast(total))  # one row


def top_talkers(flows: DataFrame, by: str = "src_ip", metric: str = "bytes", limit: int = 10) -> DataFrame:
    sums = flows.groupBy(F.col(by).alias("ip")).agg(F.sum(metric).alias("total"), F.count("*").alias("flows"))
    return sums.orderBy(F.desc("total"), "ip").limit(limit)


def protocols(flows: DataFrame) -> DataFrame:
    return flows.groupBy(protocol_name(F.col("protocol")).alias("protocol_name")).agg(
        F.count("*").alias("flows"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")
    )


def timeline(flows: DataFrame, seconds: int = 60) -> DataFrame:
    """Non-empty time buckets, each named by its first second."""
    bucket = (F.floor(F.col("t_us") / (seconds * 1_000_000)) * seconds).cast("long")
    return flows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("flows"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))


def talkers_both_ways(flows: DataFrame, limit: int = 10) -> DataFrame:
    """Hosts by bytes sent and received; each flow counts for both its ends."""
    ends = F.explode(
        F.array(
            F.struct(F.col("src_ip").alias("ip"), F.col("bytes").alias("sent"), F.lit(0).cast("long").alias("received")),
            F.struct(F.col("dst_ip").alias("ip"), F.lit(0).cast("long").alias("sent"), F.col("bytes").alias("received")),
        )
    )
    sums = flows.select(ends.alias("end"), "packets").groupBy("end.ip").agg(
        F.sum("end.sent").alias("sent"), F.sum("end.received").alias("received"), F.sum("packets").alias("packets"), F.count("*").alias("flows")
    )
    total = F.col("sent") + F.col("received")
    return sums.withColumn("total_mb", F.round(total / (1024.0 * 1024.0), 2)).orderBy(F.desc(total), "ip").limit(limit)


def protocol_share(flows: DataFrame) -> DataFrame:
    """Share of flows by protocol in percent; what is neither TCP nor UDP counts as ICMP."""
    name = F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").otherwise("ICMP")
    counts = flows.groupBy(name.alias("protocol_name")).agg(F.count("*").alias("flows"))
    total = counts.agg(F.sum("flows").alias("all_flows"))
    return counts.crossJoin(F.broadcast(total)).select("protocol_name", "flows", F.round(F.col("flows") * 100.0 / F.col("all_flows"), 1).alias("pct"))


def minute_rollup(flows: DataFrame, *keys: str) -> DataFrame:
    """Per minute and key: bytes, packets and flows."""
    minute = F.date_trunc("minute", "ts").alias("minute")
    return flows.groupBy(minute, *keys).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("flows"))


def pulse(flows: DataFrame) -> DataFrame:
    """Megabits, packets and flows per second, by second."""
    second = F.floor(F.col("t_us") / 1_000_000).cast("long")
    return flows.groupBy(second.alias("second")).agg(
        F.round(F.sum("bytes") * 8 / 1e6, 4).alias("mbps"), F.sum("packets").alias("pps"), F.count("*").alias("fps")
    )


def packet_flows(packets: DataFrame, idle_seconds: int = 15) -> DataFrame:
    """Packets to flows: by 5-tuple, ended by an idle gap."""
    gap = F.session_window("ts", f"{idle_seconds} seconds")
    keys = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    sums = packets.groupBy(*keys, gap.alias("session")).agg(
        F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.bit_or("tcp_flags").alias("tcp_flags"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")
    )
    return sums.drop("session")


def packet_exports(packets: DataFrame, idle_seconds: int = 15, every: int = 50) -> DataFrame:
    """What a probe exports of packets, by 5-tuple: counters so far at each ``every``-th packet of a flow and at its end.

    A flow ends at a packet with FIN or RST, unless that is its first, and when no packet follows for ``idle_seconds``; the next
    packet opens a new one. ``reason`` is COUNT, END or IDLE. Between pauses of a tuple a packet with FIN or RST is an end if it
    has an even place in its run, counted from the packet before it that has neither, or from the first after the pause:
    so ends are found without following one packet after the other.
    """
    keys = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    parts = [*keys, "segment"]
    cut = quiet_segments(packets.select(*keys, "t_us", "flow_id", "bytes", "tcp_flags"), keys, idle_seconds * 1_000_000)
    order = Window.partitionBy(*parts).orderBy("t_us", "flow_id")
    closing = F.col("tcp_flags").bitwiseAND(F.lit(5)) != 0
    cut = cut.withColumn("opens", (~closing | (F.row_number().over(order) == 1)).cast("int")).withColumn("run", F.sum("opens").over(order))
    place = F.row_number().over(Window.partitionBy(*parts, "run").orderBy("t_us", "flow_id"))
    cut = cut.withColumn("ends", closing & (place % 2 == 0))
    cut = cut.withColumn("flow", F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy(*parts, "flow").orderBy("t_us", "flow_id")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    counted = cut.select(
        *keys,
        "ends",
        F.count("*").over(so_far).alias("packets"),
        F.sum("bytes").over(so_far).alias("bytes"),
        F.bit_or("tcp_flags").over(so_far).alias("tcp_flags"),
        F.min("t_us").over(so_far).alias("first_us"),
        F.col("t_us").alias("last_us"),
        (F.lead("t_us").over(own).isNull() & ~F.col("ends")).alias("left_open"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("ends"), "END").when(F.col("packets") % every == 0, "COUNT"), F.when(F.col("left_open"), "IDLE")))
    return counted.withColumn("reason", F.explode(reasons)).drop("ends", "left_open")


def probe_flows(packets: DataFrame, seconds: int = 1) -> DataFrame:
    """Packets to flows: by 5-tuple and fixed interval."""
    keys = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
    bucket = F.floor(F.col("t_us") / (seconds * 1_000_000)).cast("long")
    return packets.groupBy(bucket.alias("bucket"), *keys).agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"))


def bytes_ratio(sent: Column, received: Column) -> Column:
    """Sent to received, to 3 places; what was sent if nothing came back, 1 if nothing moved."""
    one_way = F.when(sent > 0, sent.cast("double")).otherwise(1.0)
    return F.when(received <= 0, one_way).otherwise(F.round(sent / F.greatest(received, F.lit(1)), 3))


def federation(clusters: DataFrame) -> DataFrame:
    """Totals of ``clusters(cluster_id, status, mbps, alerts)``: clusters, those online, their traffic, and all alerts."""
    online = F.col("status") == "ONLINE"
    return clusters.agg(
        F.count("*").alias("clusters"),
        F.count_if(online).alias("online"),
        F.round(F.coalesce(F.sum(F.when(online, F.col("mbps"))), F.lit(0.0)), 2).alias("mbps"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
    )
