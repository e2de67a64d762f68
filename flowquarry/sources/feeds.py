"""Files and streams of other kinds: packet captures, indicator feeds, JSON telemetry, and synthetic traffic."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.wire import ip_text, number
from flowquarry.sources.flows import FLOW_SCHEMA, with_defaults

#: First bytes of a capture file, as the byte order they tell.
MAGIC = {b"\xa1\xb2\xc3\xd4": ">", b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">", b"\x4d\x3c\xb2\xa1": "<"}
KAFKA_SCHEMA = "timestamp string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, bytes long, packets long, tcp_flags int, input_snmp int, output_snmp int"


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            order = MAGIC.get(bytes(content[:4]))
            rows, at = [], 24
            while order and at + 16 <= len(content):
                secs, micros, size, _ = struct.unpack(order + "IIII", content[at : at + 16])
                if at + 16 + size > len(content):
                    break
                rows.append((path, secs * 1_000_000 + micros, bytes(content[at + 16 : at + 16 + size])))
                at += 16 + size
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=["path", "t_us", "frame"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "t_us", "frame"])


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Frames ``(path, t_us, frame)`` of classic capture files, one task per file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_frames, "path string, t_us long, frame binary")


def udp_payloads(frames: DataFrame, port: int | None = None) -> DataFrame:
    """UDP payloads of Ethernet frames, with or without a VLAN tag: ``(t_us, src_ip, dst_ip, src_port, dst_port, data)``."""
    f = F.col("frame")
    tagged = number(f, 12, 2) == 0x8100
    out = frames.withColumn("at", F.when(tagged, 18).otherwise(14)).where(F.when(tagged, number(f, 16, 2)).otherwise(number(f, 12, 2)) == 0x0800)
    at = F.col("at")
    out = out.where((number(f, at, 1).bitwiseAND(F.lit(0xF0)) == 0x40) & (number(f, at + 9, 1) == 17))
    out = out.withColumn("udp", at + (number(f, at, 1).bitwiseAND(F.lit(0x0F)) * 4).cast("int"))
    udp = F.col("udp")
    cut = out.select(
        "t_us", ip_text(f, at + 12).alias("src_ip"), ip_text(f, at + 16).alias("dst_ip"), number(f, udp, 2).cast("int").alias("src_port"),
        number(f, udp + 2, 2).cast("int").alias("dst_port"), F.substring(f, udp + 9, (number(f, udp + 4, 2) - 8).cast("int")).alias("data"),
    )
    return cut if port is None else cut.where((F.col("src_port") == port) | (F.col("dst_port") == port))


def feodo(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of a CSV block list to ``(ip, family)``: the first address, and the last column."""
    ip = F.regexp_extract("value", r"\b(\d{1,3}(?:\.\d{1,3}){3})\b", 1)
    kept = lines.where(~F.trim("value").startswith("#") & (ip != ""))
    return kept.select(ip.alias("ip"), F.trim(F.regexp_replace(F.element_at(F.split("value", ","), -1), '"', "")).alias("family"))


def stix(bundles: DataFrame) -> DataFrame:
    """``bundles(value)``, JSON texts of indicator bundles, to ``(ip, name)``."""
    kind = "struct<objects:array<struct<type:string,name:string,pattern:string>>>"
    rows = bundles.select(F.explode(F.from_json("value", kind)["objects"]).alias("o")).where("o.type = 'indicator'")
    ip = F.regexp_extract("o.pattern", r"ipv4-addr:value\s*=\s*'([^']+)'", 1)
    return rows.where(ip != "").select(ip.alias("ip"), F.col("o.name").alias("name"))


def telemetry(lines: DataFrame) -> DataFrame:
    """``lines(value)``, JSON texts of single flows, to flows with the hook's defaults."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FLOW_SCHEMA)
    return with_defaults(lines.select(F.from_json("value", kinds).alias("f")).select("f.*"))


def to_json_lines(flows: DataFrame) -> DataFrame:
    """Flows as the ``value`` column a message queue takes, keyed by the pair of hosts."""
    names = [c.split()[0] for c in KAFKA_SCHEMA.split(", ")]
    return flows.select(F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")).alias("key"), F.to_json(F.struct(*[c for c in names if c in flows.columns])).alias("value"))


def synthetic(spark: SparkSession, kind: str, n: int, start_us: int = 1_700_000_000_000_000) -> DataFrame:
    """``n`` flows of a scenario: normal, port_scan, syn_flood or exfil; the same for the same arguments."""
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    shapes = {
        "normal": (F.concat(F.lit("10.0.0."), (F.col("id") % 50).cast("string")), F.lit("142.250.190.46"), F.lit(443), F.lit(24), 10 + h % 20, 5000 + h * 10, 200_000),
        "port_scan": (F.lit("10.0.0.66"), F.lit("10.0.0.5"), (F.col("id") + 1).cast("int"), F.lit(2), F.lit(1), F.lit(60), 50_000),
        "syn_flood": (F.concat(F.lit("203.0.113."), (F.col("id") % 250).cast("string")), F.lit("10.0.0.5"), F.lit(80), F.lit(2), F.lit(1), F.lit(60), 10_000),
        "exfil": (F.lit("10.0.0.30"), F.lit("45.33.32.99"), F.lit(443), F.lit(24), F.lit(26_000), F.lit(35_000_000), 60_000_000),
    }
    src, dst, port, flags, packets, size, gap = shapes[kind]
    t = F.lit(start_us) + F.col("id") * gap
    return spark.range(n).select(
        F.col("id").alias("flow_id"), F.timestamp_micros(t).alias("ts"), t.alias("t_us"), src.alias("src_ip"), dst.alias("dst_ip"), (F.lit(40000) + F.col("id") % 20000).cast("int").alias("src_port"),
        port.cast("int").alias("dst_port"), F.lit(6).alias("protocol"), flags.alias("tcp_flags"), packets.cast("long").alias("packets"), size.cast("long").alias("bytes"),
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("ja4"), F.lit("default").alias("tenant_id"),
    )
