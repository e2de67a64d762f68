"""Flow export datagrams, versions 5, 9 and 10, to flows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.wire import ip_text, number

#: Sizes of version 5.
HEADER_V5, RECORD_V5 = 24, 48
#: Field types of templates.
FIELDS = {1: "bytes", 2: "packets", 4: "protocol", 5: "tos", 6: "tcp_flags", 7: "src_port", 8: "src_ip", 11: "dst_port", 12: "dst_ip", 15: "next_hop", 21: "first_switched", 22: "last_switched", 27: "src_ip6", 28: "dst_ip6"}
DEFAULTS = {"packets": 1, "protocol": 6}
SETS = "exporter string, domain long, seq long, secs long, version int, set_id int, body binary"


def decode_v5(packets: DataFrame) -> DataFrame:
    """``packets(exporter, data)`` to flows. A packet cut short gives its whole records; other versions give none.

    ``event_us`` is when the flow ended by the exporter's uptime clock, since records of a packet share its time.
    """
    data = F.col("data")
    head = packets.where((number(data, 0, 2) == 5) & (F.length(data) >= HEADER_V5)).select("exporter", "data", number(data, 4, 4).alias("uptime"), number(data, 8, 4).alias("secs"), number(data, 2, 2).alias("count"))
    whole = F.least(F.col("count"), F.floor((F.length("data") - HEADER_V5) / RECORD_V5)).cast("int")
    rows = head.where(whole > 0).select("exporter", "data", "uptime", "secs", F.explode(F.sequence(F.lit(0), whole - 1)).alias("i"))
    rows = rows.withColumn("r", F.substring("data", F.col("i") * RECORD_V5 + HEADER_V5 + 1, F.lit(RECORD_V5)))
    r = F.col("r")
    return rows.select(
        "exporter",
        F.timestamp_seconds("secs").alias("ts"),
        ip_text(r, 0).alias("src_ip"),
        ip_text(r, 4).alias("dst_ip"),
        ip_text(r, 8).alias("next_hop"),
        *[number(r, at, size).alias(name) for name, at, size in (("packets", 16, 4), ("bytes", 20, 4), ("first_switched", 24, 4), ("last_switched", 28, 4))],
        *[number(r, at, size).cast("int").alias(name) for name, at, size in (("src_port", 32, 2), ("dst_port", 34, 2), ("tcp_flags", 37, 1), ("protocol", 38, 1), ("tos", 39, 1))],
        (F.col("secs") * 1_000_000 - (F.col("uptime") - number(r, 28, 4)) * 1000).alias("event_us"),
        F.lit(5).alias("flow_version"),
    )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of version 9 and 10 datagrams; a broken length ends a datagram."""
    for batch in batches:
        rows = []
        for exporter, data in zip(batch["exporter"], batch["data"], strict=True):
            if data is None or len(data) < 16:
                continue
            version = int.from_bytes(data[:2], "big")
            if version == 9 and len(data) >= 20:
                secs, seq, domain = struct.unpack("!III", data[8:20])
                at = 20
            elif version == 10:
                secs, seq, domain = struct.unpack("!III", data[4:16])
                at = 16
            else:
                continue
            while at + 4 <= len(data):
                set_id, size = struct.unpack("!HH", data[at : at + 4])
                if size < 4 or at + size > len(data):
                    break
                rows.append((exporter, domain, seq, secs, version, set_id, bytes(data[at + 4 : at + size])))
                at += size
        yield pd.DataFrame(rows, columns=["exporter", "domain", "seq", "secs", "version", "set_id", "body"])


def _templates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fields of template sets, one row each; an enterprise number is skipped."""
    for batch in batches:
        rows = []
        for s in batch.itertuples(index=False):
            at = 0
            while at + 4 <= len(s.body):
                template, count = struct.unpack("!HH", s.body[at : at + 4])
                at += 4
                fields, offset = [], 0
                for _ in range(count):
                    if at + 4 > len(s.body):
                        break
                    kind, size = struct.unpack("!HH", s.body[at : at + 4])
                    at += 4
                    if s.version == 10 and kind & 0x8000:
                        kind &= 0x7FFF
                        at += 4
                    fields.append({"kind": kind, "size": size, "at": offset})
                    offset += size
                rows.append((s.exporter, s.domain, s.seq, template, offset, fields))
        yield pd.DataFrame(rows, columns=["exporter", "domain", "seq", "set_id", "width", "fields"])


def decode_templated(packets: DataFrame) -> DataFrame:
    """``packets(exporter, data)`` of versions 9 and 10 to flows.

    Templates are gathered first, the latest of each exporter, domain and id, and joined to the data sets,
    so data that comes before its template is decoded too. Records are cut out by column expressions.
    """
    sets = packets.select("exporter", "data").mapInPandas(_sets, SETS)
    is_template = ((F.col("version") == 9) & (F.col("set_id") == 0)) | ((F.col("version") == 10) & (F.col("set_id") == 2))
    shape = "exporter string, domain long, seq long, set_id int, width int, fields array<struct<kind:int,size:int,at:int>>"
    listed = sets.where(is_template).mapInPandas(_templates, shape)
    latest = listed.groupBy("exporter", "domain", "set_id").agg(F.max_by(F.struct("width", "fields"), "seq").alias("t"))
    data = sets.where("set_id >= 256").join(latest, ["exporter", "domain", "set_id"]).where("t.width > 0 and length(body) >= t.width")
    last = F.floor(F.length("body") / F.col("t.width")).cast("int") - 1
    rows = data.select("exporter", "secs", "version", "t", "body", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    rows = rows.select("exporter", "secs", "version", F.col("t.fields").alias("fields"), F.substring("body", F.col("i") * F.col("t.width") + 1, F.col("t.width")).alias("r"))

    def field(kind: int) -> Column:
        piece = F.transform(F.filter("fields", lambda f: f["kind"] == kind), lambda f: F.substring(F.col("r"), f["at"] + 1, f["size"]))
        return F.get(piece, F.size(piece) - 1)

    def value(name: str) -> Column:
        kind = next(k for k, n in FIELDS.items() if n == name)
        return F.coalesce(F.conv(F.hex(field(kind)), 16, 10).cast("long"), F.lit(DEFAULTS.get(name, 0)).cast("long"))

    def v6(kind: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.substr(F.hex(field(kind)), i * 4 + 1, F.lit(4)))), ":")

    def address(v4: int, six: int) -> Column:
        return F.coalesce(F.when(F.length(field(v4)) == 4, ip_text(field(v4), 0)), F.when(F.length(field(six)) == 16, v6(six)), F.lit("0.0.0.0"))

    longs = [value(n).alias(n) for n in ("packets", "bytes", "first_switched", "last_switched")]
    ints = [value(n).cast("int").alias(n) for n in ("src_port", "dst_port", "tcp_flags", "protocol", "tos")]
    return rows.select(
        "exporter", F.timestamp_seconds("secs").alias("ts"), address(8, 27).alias("src_ip"), address(12, 28).alias("dst_ip"),
        F.coalesce(F.when(F.length(field(15)) == 4, ip_text(field(15), 0)), F.lit("0.0.0.0")).alias("next_hop"), *longs, *ints,
        F.lit(None).cast("long").alias("event_us"), F.col("version").alias("flow_version"),
    )


def decode(packets: DataFrame) -> DataFrame:
    """Flows of all three versions; what is none of them is left out."""
    return decode_v5(packets).unionByName(decode_templated(packets))
