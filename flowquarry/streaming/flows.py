"""The flow analytics as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowquarry.operators.detect import has_bits

SESSION = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
SCAN_STATE = "times array<long>, ports array<int>, targets array<string>, last long"
SCAN_ALERT = "src_ip string, t_us long, severity string, n_ports int, n_targets int"


def minute_rollup(flows: DataFrame, *keys: str, late: str = "2 minutes") -> DataFrame:
    """Bytes, packets and flows per minute and key; rows later than ``late`` are dropped."""
    return (
        flows.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 minute"), *keys)
        .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("flows"))
        .select(F.col("window.start").alias("minute"), *keys, "bytes", "packets", "flows")
    )


def packet_flows(packets: DataFrame, idle: str = "15 seconds", late: str = "30 seconds") -> DataFrame:
    """Packets to flows by 5-tuple, ended by an idle gap."""
    return (
        packets.withWatermark("ts", late)
        .groupBy(*SESSION, F.session_window("ts", idle))
        .agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.bit_or("tcp_flags").alias("tcp_flags"))
        .select(*SESSION, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("end"), "packets", "bytes", "tcp_flags")
    )


def _scan(least: int, seconds: float, cooldown: float) -> Callable:
    width, pause = int(seconds * 1e6), int(cooldown * 1e6)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, ports, targets, last = state.get if state.exists else ([], [], [], None)
        held = list(zip(times, ports, targets, strict=True))
        rows = pd.concat(list(batches)).sort_values(["t_us", "flow_id"])
        out = []
        for t, same in rows.groupby("t_us", sort=True):  # rows of one time see each other
            held = [h for h in held if t - h[0] <= width] + [(t, p, d) for p, d in zip(same["dst_port"], same["dst_ip"], strict=True)]
            n = len({p for _, p, _ in held})
            if n >= least and (last is None or t - last >= pause):
                last = int(t)
                out.append((key[0], int(t), "HIGH" if n >= 30 else "MEDIUM", n, len({d for _, _, d in held})))
        times, ports, targets = ([int(h[0]) for h in held], [int(h[1]) for h in held], [h[2] for h in held])
        state.update((times, ports, targets, last))
        newest = int(rows["t_us"].max() / 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + int(max(seconds, cooldown) * 1000) + 1)
        yield pd.DataFrame(out, columns=["src_ip", "t_us", "severity", "n_ports", "n_targets"])

    return run


def port_scan(flows: DataFrame, least: int = 15, seconds: float = 10, cooldown: float = 30, late: str = "10 seconds") -> DataFrame:
    """The port-scan alerts of :func:`flowquarry.operators.detect.port_scan` with their cooldown, as flows come.

    A source's state is the probes of its last window and its last alert, and goes when it has been quiet.
    """
    syn, xmas = has_bits(F.col("tcp_flags"), 2), has_bits(F.col("tcp_flags"), 0x29)
    probes = flows.where((F.col("protocol") == 6) & (F.col("packets") <= 4) & (syn | F.col("tcp_flags").isin(0, 1) | xmas))
    cut = probes.select("src_ip", "dst_ip", "dst_port", "t_us", "flow_id", "ts").withWatermark("ts", late)
    return cut.groupBy("src_ip").applyInPandasWithState(_scan(least, seconds, cooldown), SCAN_ALERT, SCAN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a query that hands each micro-batch to ``write``; without ``every`` it takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Plugins:
    """User detectors: functions from flows to fired rows. One that fails is left out and its error kept."""

    def __init__(self) -> None:
        self.detectors: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.errors: dict[str, str] = {}

    def add(self, name: str, detector: Callable[[DataFrame], DataFrame]) -> None:
        self.detectors[name] = detector

    def run(self, flows: DataFrame) -> DataFrame | None:
        out = None
        for name, detector in self.detectors.items():
            try:
                one = detector(flows)
                one.schema  # noqa: B018  a plan that cannot be resolved fails here
            except Exception as error:
                self.errors[name] = str(error)
                continue
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out
