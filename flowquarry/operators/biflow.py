"""Both directions of a conversation in one row, its ratio, and host-pair sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.net import canonical_pair
from flowquarry.operators.analytics import bytes_ratio
from flowquarry.operators.blocks import running_sums


def _key() -> list[Column]:
    low, high = canonical_pair(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    return [low.alias("low"), high.alias("high"), F.col("protocol")]


def opener() -> Column:
    """Which end opened it: by SYN, then SYN and ACK, then the lower source port belongs to the server."""
    syn, ack = F.col("tcp_flags").bitwiseAND(F.lit(2)) > 0, F.col("tcp_flags").bitwiseAND(F.lit(16)) > 0
    forward = F.when(syn & ack, False).when(syn, True).otherwise(F.col("src_port") >= F.col("dst_port"))
    return F.when(forward, F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))).otherwise(
        F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    )


def sessions(flows: DataFrame, idle_s: float | None = None) -> DataFrame:
    """One row per conversation: who asked, bytes and packets each way, flags, first and last time, state and ratio.

    The client is what the first flow says. State is RESET, ESTABLISHED or UNANSWERED, for TCP after more than one flow.
    With ``idle_s`` a conversation that is quiet for longer has ended, and the next flow opens a new one. So it works on a stream with a
    watermark as well, where a conversation's row comes and its state goes once the watermark has passed its end.
    """
    keyed = flows.select("*", *_key()[:2], opener().alias("opener"))
    first = F.min_by("opener", F.struct("t_us", "flow_id"))
    ends = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    low = ends == F.col("low")
    idle = [] if idle_s is None else [F.session_window("ts", f"{int(idle_s * 1_000_000)} microseconds")]
    sums = keyed.groupBy("low", "high", "protocol", *idle).agg(
        first.alias("client"),
        F.sum(F.when(low, F.col("bytes")).otherwise(0)).alias("low_bytes"),
        F.sum(F.when(low, 0).otherwise(F.col("bytes"))).alias("high_bytes"),
        F.sum(F.when(low, F.col("packets")).otherwise(0)).alias("low_packets"),
        F.sum(F.when(low, 0).otherwise(F.col("packets"))).alias("high_packets"),
        F.bit_or("tcp_flags").alias("flags"),
        F.bool_or((F.col("tcp_flags").bitwiseAND(F.lit(18)) == 18)).alias("answered"),
        F.min("t_us").alias("first_us"),
        F.max("t_us").alias("last_us"),
        F.count("*").alias("flows"),
    )
    is_low = F.col("client") == F.col("low")
    sent = F.when(is_low, F.col("low_bytes")).otherwise(F.col("high_bytes"))
    received = F.when(is_low, F.col("high_bytes")).otherwise(F.col("low_bytes"))
    reset = F.col("flags").bitwiseAND(F.lit(4)) > 0
    open_ = (received > 0) | F.col("answered")
    state = F.when((F.col("protocol") != 6) | (F.col("flows") < 2), F.lit(None)).when(reset, "RESET").when(open_, "ESTABLISHED").otherwise("UNANSWERED")
    server = F.when(is_low, F.col("high")).otherwise(F.col("low"))
    return sums.select(
        F.col("client.ip").alias("client_ip"),
        F.col("client.port").alias("client_port"),
        server["ip"].alias("server_ip"),
        server["port"].alias("server_port"),
        "protocol",
        sent.alias("sent"),
        received.alias("received"),
        F.when(is_low, F.col("low_packets")).otherwise(F.col("high_packets")).alias("sent_packets"),
        F.when(is_low, F.col("high_packets")).otherwise(F.col("low_packets")).alias("received_packets"),
        "flags",
        "first_us",
        "last_us",
        "flows",
        state.alias("state"),
        bytes_ratio(sent, received).alias("ratio"),
    )


def pair_ratio(flows: DataFrame) -> DataFrame:
    """Bytes each way and their ratio for each unordered pair of hosts, the smaller address first."""
    low, high = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
    forward = F.col("src_ip") <= F.col("dst_ip")
    sums = flows.groupBy(low.alias("ip_a"), high.alias("ip_b")).agg(
        F.sum(F.when(forward, F.col("bytes")).otherwise(0)).alias("a_to_b"), F.sum(F.when(forward, 0).otherwise(F.col("bytes"))).alias("b_to_a")
    )
    return sums.withColumn("ratio", bytes_ratio(F.col("a_to_b"), F.col("b_to_a")))


def running_ratio(flows: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Flows with ``sent``, ``received`` and ``ratio`` of their conversation as of each flow; ``base`` as in ``blocks.running_sums``."""
    low, high, _ = _key()
    ends = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    keyed = flows.select("*", low, high)
    volumes = {"from_low": F.when(ends == F.col("low"), F.col("bytes")), "from_both": F.col("bytes")}
    plain = None if base is None else base.select("*", low, high)
    summed = running_sums(keyed, ["low", "high", "protocol"], volumes, {"client": opener()}, base=plain)
    other = F.col("from_both") - F.col("from_low")
    by_low = F.col("client") == F.col("low")
    sent, received = F.when(by_low, F.col("from_low")).otherwise(other), F.when(by_low, other).otherwise(F.col("from_low"))
    out = summed.withColumns({"sent": sent, "received": received})
    return out.select(*flows.columns, "sent", "received", bytes_ratio(F.col("sent"), F.col("received")).alias("ratio"))
