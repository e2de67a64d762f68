"""Evidence of alerts as capture files: frames made from flows, and files of frames with their digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import ip_number
from flowquarry.functions.wire import big_endian, little_endian

#: The capture format's file header, and the addresses, window and identification of made frames.
FILE_HEADER = "D4C3B2A1" "02000400" "00000000" "00000000" "FFFF0000" "01000000"
ETHERNET = "005056C00001" "005056C00008" "0800"
#: Frames in a file; an alert with more gets several files.
FRAMES = 10_000


def frame(src: Column, dst: Column, src_port: Column, dst_port: Column, protocol: Column, flags: Column, seq: Column, text: Column) -> Column:
    """Hexadecimal digits of an Ethernet frame that carries ``text``. A protocol other than TCP, UDP and ICMP is framed as TCP."""
    size = F.octet_length(text)
    ports = F.concat(big_endian(src_port, 2), big_endian(dst_port, 2))
    tcp = F.concat(ports, big_endian(seq, 4), F.lit("00000000" "50"), big_endian(flags, 1), F.lit("FAF0" "0000" "0000"))
    udp = F.concat(ports, big_endian(size + 8, 2), F.lit("0000"))
    segment = F.when(protocol == 17, udp).when(protocol == 1, F.lit("0800" "0000" "1234" "0001")).otherwise(tcp)
    length = F.when(protocol.isin(1, 17), 28).otherwise(40) + size
    header = F.concat(F.lit("4500"), big_endian(length, 2), F.lit("1234" "4000" "40"), big_endian(protocol, 1), F.lit("0000"), big_endian(ip_number(src), 4), big_endian(ip_number(dst), 4))
    return F.concat(F.lit(ETHERNET), header, segment, F.hex(text.cast("binary")))


def frames(alerts: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Rows ``(alert_id, nth, t_us, frame)``: one for each flow of an alert, or five made-up ones for an alert without any.

    ``flows(alert_id, src_ip, dst_ip, src_port, dst_port, protocol, tcp_flags, flow_id)`` name their alert.
    Frames of flows are 50 ms apart, others 100 ms.
    """
    shots = alerts.select("alert_id", "t_us", "src_ip", "dst_ip", "dst_port", "protocol", "category", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("nth"))
    if flows is not None:
        shots = shots.join(flows.select("alert_id").distinct(), "alert_id", "left_anti")
    protocol = F.coalesce("protocol", F.lit(6))
    said = F.concat(F.lit("evidence alert:"), "alert_id", F.lit(" category:"), "category", F.lit(" packet:"), (F.col("nth") + 1).cast("string"))
    bare = frame(F.col("src_ip"), F.col("dst_ip"), F.col("nth") + 49152, F.when(F.col("dst_port") > 0, F.col("dst_port")).otherwise(F.col("nth") + 80), protocol, F.when(F.col("protocol") == 6, 2).otherwise(0), F.col("nth") * 1000 + 10000, said)
    made = shots.select("alert_id", "nth", (F.col("t_us") + F.col("nth") * 100_000).alias("t_us"), bare.alias("frame"))
    if flows is None:
        return made
    order = Window.partitionBy("alert_id").orderBy("flow_id")
    owned = flows.join(alerts.select("alert_id", "t_us"), "alert_id").withColumn("nth", F.row_number().over(order) - 1)
    said = F.concat(F.lit("evidence alert:"), "alert_id", F.lit(" flow:"), (F.col("nth") + 1).cast("string"))
    seen = frame(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), F.col("protocol"), F.col("tcp_flags"), F.col("nth") * 100 + 1000, said)
    return made.unionByName(owned.select("alert_id", "nth", (F.col("t_us") + F.col("nth") * 50_000).alias("t_us"), seen.alias("frame")))


def captures(frame_rows: DataFrame, frames_per_file: int = FRAMES) -> DataFrame:
    """Rows ``(alert_id, part, n_packets, content, sha256)``: capture files of at most ``frames_per_file`` frames."""
    size = F.length("frame") / 2
    record = F.concat(little_endian(F.floor(F.col("t_us") / 1_000_000), 4), little_endian(F.col("t_us") % 1_000_000, 4), little_endian(size, 4), little_endian(size, 4), F.col("frame"))
    parts = frame_rows.select("alert_id", F.floor(F.col("nth") / frames_per_file).cast("int").alias("part"), F.struct("nth", record.alias("record")).alias("packet"))
    files = parts.groupBy("alert_id", "part").agg(F.count("*").alias("n_packets"), F.array_sort(F.collect_list("packet")).alias("packets"))
    content = F.unhex(F.concat(F.lit(FILE_HEADER), F.array_join(F.transform("packets", lambda p: p["record"]), "")))
    return files.select("alert_id", "part", "n_packets", content.alias("content")).withColumn("sha256", F.sha2("content", 256))
