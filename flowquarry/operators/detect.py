"""Sliding-window detectors over flows.

Each detector filters first, so that only candidate rows are shuffled, and looks back over a closed event-time
window of its key, the row itself included. Rows with equal times see each other. A detector returns the
rows that fire, as ``FIRE`` columns; :func:`with_cooldown` then thins them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import has_private_prefix, is_internal, is_private
from flowquarry.operators.biflow import running_ratio
from flowquarry.operators.blocks import history, quiet_segments

#: Windows in a slice of a key's time; one window in so many is handed on twice.
SLICE_WINDOWS = 60
#: Figures of the gaps between a key's rows: their number, sum and sum of squares.
GAP_FIGURES = ("n_gaps", "sum_gaps", "sum_gaps_squared")
FIRE = ("detector", "category", "severity", "confidence", "cooldown_s", "key", "src_ip", "dst_ip", "dst_port", "protocol", "t_us", "flow_id", "evidence")
#: What ``FIRE`` takes from a flow.
FLOW_COLUMNS = ("flow_id", "t_us", "src_ip", "dst_ip", "dst_port", "protocol")
#: Ports of remote administration, TLS ports, and resolvers that are trusted at normal size.
ADMIN_PORTS = (22, 135, 139, 445, 3389, 5985, 5986)
TLS_PORTS = (443, 8443, 9443)
RESOLVERS = ("1.1.1.1", "1.0.0.1", "8.8.8.8", "8.8.4.4", "9.9.9.9", "149.112.112.112", "192.168.1.1", "10.0.0.1")


def lookback(keys: list[str], seconds: float) -> Window:
    return Window.partitionBy(*keys).orderBy("t_us").rangeBetween(-int(seconds * 1_000_000), 0)


def swept(
    rows: DataFrame, keys: list[str], seconds: float, sums: dict[str, Column] | None = None, distinct: dict[str, str] | None = None, gaps: tuple[float, float] | None = None
) -> DataFrame:
    """``rows`` with sums of whole numbers, and counts of distinct values that are not null, over the closed look-back window.

    A value counts from its row until the window has moved past it, a distinct one at most until it occurs
    again. So a row is a start and some ends, and running sums over both give all figures: the work of a
    key grows with its rows, not with rows times window as that of a sliding frame does. With ``gaps``, a range of
    seconds, there are also ``GAP_FIGURES``: number, sum and sum of squares in microseconds of the key's gaps between rows longer than its start and no
    longer than its end; a gap counts while all of it is in the window, so it ends with the row that it begins at.

    A key's time is cut into slices of ``SLICE_WINDOWS`` windows, which go to different tasks, so a busy key is not
    one task's work; the last window of a slice is also handed to the next one, for the figures at its start.
    """
    sums, distinct, columns = sums or {}, distinct or {}, rows.columns
    window = int(seconds * 1_000_000) + 1
    length = window * SLICE_WINDOWS
    between: dict[str, Column] = {}
    after: dict[str, Column] = {}
    if gaps:
        near = Window.partitionBy(*keys).orderBy("t_us")
        rows = rows.withColumns({"before_us": F.lag("t_us").over(near), "after_us": F.lead("t_us").over(near)})

        def figures(gap: Column) -> dict[str, Column]:
            gap = F.when(gap > int(gaps[0] * 1_000_000), F.when(gap <= int(min(gaps[1], seconds) * 1_000_000), gap))
            return dict(zip(GAP_FIGURES, (gap.isNotNull().cast("int"), gap, gap * gap), strict=True))

        # a gap that begins before what is handed to the next slice is over there
        over = F.col("carried") & (F.col("before_us") < F.col("slice") * length - window)
        between = {n: F.when(over, 0).otherwise(v) for n, v in figures(F.col("t_us") - F.col("before_us")).items()}
        after = figures(F.col("after_us") - F.col("t_us"))
    own = F.floor(F.col("t_us") / length)
    carried = F.when(F.pmod(F.col("t_us"), F.lit(length)) >= length - window, F.struct((own + 1).alias("slice"), F.lit(True).alias("carried")))
    carried_along, keys = rows.columns, [*keys, "slice"]
    places = F.array_compact(F.array(F.struct(own.alias("slice"), F.lit(False).alias("carried")), carried))
    rows = rows.select("*", F.explode(places).alias("place")).select(*carried_along, "place.slice", "place.carried")
    past = F.col("t_us") + window
    again = {name: F.lead("t_us").over(Window.partitionBy(*keys, c).orderBy("t_us")) for name, c in distinct.items()}
    plus = {name: F.coalesce(v.cast("long"), F.lit(0)) for name, v in (sums | between).items()} | {name: F.col(c).isNotNull().cast("long") for name, c in distinct.items()}
    until = {name: F.least(past, F.coalesce(again[name], past)) for name in distinct}
    less = {name: F.coalesce(v.cast("long"), F.lit(0)) for name, v in after.items()}
    held = rows.select(
        *keys,
        "t_us",
        F.when(~F.col("carried"), F.struct(*columns)).alias("row"),
        *[v.alias(f"plus_{name}") for name, v in plus.items()],
        *[v.alias(f"less_{name}") for name, v in less.items()],
        *[v.alias(f"until_{name}") for name, v in until.items()],
    )
    nothing = F.lit(None).cast(held.schema["row"].dataType)

    def event(at: Column, row: Column, added: dict[str, Column]) -> Column:
        return F.struct(at.alias("at"), row.alias("row"), *[added.get(n, F.lit(0).cast("long")).alias(n) for n in plus])

    events = [event(F.col("t_us"), F.col("row"), {n: F.col(f"plus_{n}") for n in plus})]
    ends = {n: -F.col(f"plus_{n}") for n in sums} | {n: -F.col(f"less_{n}") for n in less}
    events += [event(past, nothing, ends)] if ends else []
    events += [event(F.col(f"until_{name}"), nothing, {name: -F.col(f"plus_{name}")}) for name in distinct]
    w = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    moves = held.select(*keys, F.explode(F.array(*events)).alias("e")).select(*keys, "e.at", "e.row", *[F.col(f"e.{n}") for n in plus])
    return moves.select("row", *[F.sum(n).over(w).alias(n) for n in plus]).where("row is not null").select("row.*", *plus)


def recent(rows: DataFrame, keys: list[str], n: int, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of a value over the last ``n`` of their key, the row itself included."""
    return rows.withColumn(name, F.sum(value.cast("int")).over(Window.partitionBy(*keys).orderBy("t_us", "flow_id").rowsBetween(1 - n, 0)))


class Table:
    """What the detectors are written over, for flows that are a table; :mod:`flowquarry.streaming.keyed` has the same for a stream."""

    swept, history, running_ratio, recent = staticmethod(swept), staticmethod(history), staticmethod(running_ratio), staticmethod(recent)


class Known(Table):
    """The same for flows that :func:`with_past` has given their history and volumes, which are then not worked out again."""

    @staticmethod
    def history(rows: DataFrame, keys: list[str], value: str, own: bool) -> DataFrame:
        return rows

    @staticmethod
    def running_ratio(rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
        return rows


TABLE, KNOWN = Table(), Known()


def with_past(flows: DataFrame) -> DataFrame:
    """Flows with the history of their source's bytes and the volumes of their conversation, as of each flow."""
    return running_ratio(history(flows, ["src_ip"], "bytes", own=True), flows)


def has_bits(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def fires(rows: DataFrame, detector: str, category: str, severity: Column, confidence: Column, cooldown_s: float, keys: list[str], evidence: Column) -> DataFrame:
    made = {
        "detector": F.lit(detector),
        "category": F.lit(category),
        "severity": severity,
        "confidence": F.round(confidence + 1e-9, 2),  # halves go up, whatever the sum's last bit
        "cooldown_s": F.lit(float(cooldown_s)),
        "key": F.concat_ws("|", *[F.col(k).cast("string") for k in keys]),
        "evidence": evidence.cast("double"),
    }
    columns = [made[c].alias(c) if c in made else F.col(c) for c in FIRE]
    return rows.select(*columns, "ts") if rows.isStreaming else rows.select(*columns)  # a stream keeps its event time


def _slim(rows: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an alert is made of, and ``more``: all that are left go through the shuffles of a look-back."""
    return rows if rows.isStreaming else rows.select(*FLOW_COLUMNS, *more)


def _keep_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by detector, key, segment and time, those that come a cooldown after the last one kept."""
    current, last = None, 0
    for batch in batches:
        keep = []
        for *place, t, cooldown in zip(*[batch[c] for c in ("detector", "key", "segment", "t_us", "cooldown_s")], strict=True):
            fresh = place != current or t - last >= cooldown * 1_000_000
            if fresh:
                current, last = place, t
            keep.append(fresh)
        yield batch[keep]


def with_cooldown(fired: DataFrame) -> DataFrame:
    """Fired rows of any number of detectors without those inside the cooldown of the one kept before, by detector and key.

    All detectors go together. After a pause as long as its cooldown a key starts anew, so what lies between such pauses
    can go to different tasks. A partition is sorted and streamed, with one row remembered.
    """
    keys = ["detector", "key", "segment"]
    parts = quiet_segments(fired, keys[:2], (F.col("cooldown_s") * 1_000_000).cast("long"))
    spread = parts.repartition(*keys).sortWithinPartitions(*keys, "t_us", "flow_id")
    return spread.mapInPandas(_keep_first, spread.schema).drop("segment")


def port_scan(flows: DataFrame, ports: int = 15, seconds: float = 10, over: Table = TABLE) -> DataFrame:
    syn, xmas = has_bits(F.col("tcp_flags"), 2), has_bits(F.col("tcp_flags"), 0x29)
    probes = flows.where((F.col("protocol") == 6) & (F.col("packets") <= 4) & (syn | F.col("tcp_flags").isin(0, 1) | xmas))
    seen = over.swept(_slim(probes, "tcp_flags"), ["src_ip"], seconds, distinct={"n_ports": "dst_port", "n_targets": "dst_ip"}).where(F.col("n_ports") >= ports)
    bonus = F.least(F.lit(0.09), F.col("n_ports") / 50.0 * 0.09) + F.least(F.lit(0.04), (F.col("n_targets") - 1) * 0.01) + F.when(syn, 0.0).otherwise(0.02)
    return fires(seen, "port_scan", "PORT_SCAN", F.when(F.col("n_ports") >= 30, "HIGH").otherwise("MEDIUM"), F.least(F.lit(0.99), 0.85 + bonus), 30, ["src_ip"], F.col("n_ports"))


def syn_flood(flows: DataFrame, count: int = 30, seconds: float = 5, over: Table = TABLE) -> DataFrame:
    bare = (F.col("protocol") == 6) & has_bits(F.col("tcp_flags"), 2) & ~has_bits(F.col("tcp_flags"), 16) & (F.col("packets") <= 4)
    keys = ["dst_ip", "dst_port"]
    seen = over.swept(_slim(flows.where(bare)), keys, seconds, {"n": F.lit(1)}, {"sources": "src_ip"}).where(F.col("n") >= count)
    bonus = F.least(F.lit(0.06), (F.col("n") - count) * 0.002) + F.least(F.lit(0.05), F.col("sources") / F.col("n") * 0.05)
    return fires(seen, "syn_flood", "SYN_FLOOD", F.when(F.col("n") >= 60, "CRITICAL").otherwise("HIGH"), F.least(F.lit(0.99), 0.88 + bonus), 20, keys, F.col("n"))


def bandwidth_exfil(flows: DataFrame, trusted: tuple[str, ...] = (), single: int = 20_000_000, total: int = 50_000_000, seconds: float = 60, over: Table = TABLE) -> DataFrame:
    """Large or unusual volumes to outside. The host's own row is part of its baseline; downloads do not count."""
    z = F.when(F.col("deviation_before") > 1e-4, F.round((F.col("bytes") - F.col("mean_before")) / F.col("deviation_before"), 2)).otherwise(0.0)
    known = over.running_ratio(over.history(flows, ["src_ip"], "bytes", own=True).withColumn("z", z), flows)
    outward = is_internal(F.col("src_ip")) & ~is_internal(F.col("dst_ip"))
    out = known.where(outward if not trusted else outward & ~F.col("dst_ip").isin(*trusted))
    keys = ["src_ip", "dst_ip"]
    summed = over.swept(_slim(out, "bytes", "n_before", "z", "received", "ratio"), keys, seconds, {"volume": F.col("bytes")})
    odd = (F.col("n_before") >= 10) & (F.col("z") >= 3.5) & (F.col("bytes") >= 1_000_000)
    download = (F.col("received") > 0) & (F.col("ratio") < 0.2)
    seen = summed.where(((F.col("bytes") >= single) | (F.col("volume") >= total) | odd) & ~download)
    mb = F.greatest("bytes", "volume") / (1024.0 * 1024.0)
    bonus = (
        F.when(mb >= 20, F.least(F.lit(0.08), (mb - 20) * 0.003)).otherwise(0.0)
        + F.when(F.col("dst_port").isin(80, 443, 8080), 0.0).otherwise(0.04)
        + F.when((F.col("received") > 0) & (F.col("ratio") > 20), 0.04).otherwise(0.0)
        + F.when(odd, 0.05).otherwise(0.0)
    )
    return fires(seen, "bandwidth_exfil", "EXFILTRATION", F.when(mb >= 50, "CRITICAL").otherwise("HIGH"), F.least(F.lit(0.99), 0.86 + bonus), 45, keys, F.col("volume"))


def dns_volume(flows: DataFrame, size: int = 320, packets: int = 25, seconds: float = 10, over: Table = TABLE) -> DataFrame:
    mean = F.col("bytes") / F.greatest("packets", F.lit(1))
    normal = F.col("dst_ip").isin(*RESOLVERS) & (F.col("packets") > 0) & (mean < size)
    keys = ["src_ip", "dst_ip"]
    dns = flows.where((F.col("protocol") == 17) & (F.col("dst_port") == 53) & ~normal)
    seen = over.swept(_slim(dns, "bytes", "packets"), keys, seconds, {"sum_packets": F.col("packets"), "sum_bytes": F.col("bytes")}).withColumn("mean", mean)
    seen = seen.where((F.col("mean") >= size) | ((F.col("sum_packets") >= packets) & (F.col("sum_bytes") / F.greatest("sum_packets", F.lit(1)) > 250)))
    bonus = F.greatest(F.lit(0.0), F.least(F.lit(0.08), (F.col("mean") - size) / 1000.0)) + F.greatest(F.lit(0.0), F.least(F.lit(0.05), (F.col("sum_packets") - packets) * 0.002))
    return fires(seen, "dns_volume", "DNS_TUNNEL", F.lit("HIGH"), F.least(F.lit(0.98), 0.85 + bonus), 30, keys, F.col("sum_bytes"))


def beaconing(flows: DataFrame, samples: int = 5, seconds: float = 600, low_s: float = 2, high_s: float = 300, cv: float = 0.35, over: Table = TABLE) -> DataFrame:
    """Connections at nearly equal intervals. Shorter gaps than 50 ms are one burst and do not count."""
    cast = F.col("dst_ip").startswith("224.") | F.col("dst_ip").startswith("239.") | (F.col("dst_ip") == "255.255.255.255")
    keys = ["src_ip", "dst_ip", "dst_port"]
    rows = flows.where((F.col("bytes") <= 500_000) & ~cast)
    seen = over.swept(_slim(rows), keys, seconds, {"n": F.lit(1)}, gaps=(0.05, seconds))
    m, total, squares = (F.col(c) for c in GAP_FIGURES)
    seen = seen.where((F.col("n") >= samples) & (m >= samples - 1)).withColumn("mean_us", total / m)
    spread = F.sqrt(F.greatest(F.lit(0.0), squares - total * F.col("mean_us")) / F.greatest(m - 1, F.lit(1)))
    seen = seen.withColumns({"mean_s": F.col("mean_us") / 1e6, "cv": F.try_divide(spread, F.col("mean_us"))})
    seen = seen.where(F.col("mean_s").between(low_s, high_s) & (F.col("cv") <= cv))
    severity = F.when(~is_private(F.col("dst_ip")) & ~F.col("dst_port").isin(80, 443), "CRITICAL").otherwise("HIGH")
    return fires(seen, "beaconing", "C2_BEACONING", severity, F.least(F.lit(0.98), F.greatest(F.lit(0.85), 1 - F.col("cv"))), 180, keys, F.col("mean_s"))


def lateral_movement(flows: DataFrame, roles: DataFrame | None = None, allowed: tuple[str, ...] = (), targets: int = 3, seconds: float = 30, over: Table = TABLE) -> DataFrame:
    """One internal host reaching several others on administration ports; managers and domain controllers may."""
    inner = is_internal(F.col("src_ip")) & is_internal(F.col("dst_ip")) & (F.col("src_ip") != F.col("dst_ip")) & F.col("dst_port").isin(*ADMIN_PORTS)
    out = flows.where(inner if not allowed else inner & ~F.col("src_ip").isin(*allowed))
    if roles is not None:
        managers = roles.where(F.col("role").isin("ADMIN_MANAGEMENT", "INFRASTRUCTURE_DC")).select(F.col("ip").alias("src_ip"))
        out = out.join(managers, "src_ip", "left_anti")
    on = lambda port: (F.col("dst_port") == port).cast("int")
    seen = over.swept(_slim(out), ["src_ip"], seconds, {"on_smb": on(445), "on_rdp": on(3389)}, {"n": "dst_ip"}).where(F.col("n") >= targets)
    smb, rdp = F.col("on_smb") > 0, F.col("on_rdp") > 0
    severity = F.when((F.col("n") >= 6) | (smb & rdp), "CRITICAL").when((F.col("n") >= 4) | smb, "HIGH").otherwise("MEDIUM")
    bonus = F.least(F.lit(0.08), (F.col("n") - targets) * 0.02) + F.when(smb, 0.03).otherwise(0.0)
    return fires(seen, "lateral_movement", "LATERAL_MOVEMENT", severity, F.least(F.lit(0.99), 0.88 + bonus), 45, ["src_ip"], F.col("n"))


def _tls(flows: DataFrame) -> DataFrame:
    tls = (F.col("protocol") == 6) & (F.col("dst_port").isin(*TLS_PORTS) | F.col("src_port").isin(*TLS_PORTS))
    inside = has_private_prefix(F.col("src_ip")) & has_private_prefix(F.col("dst_ip"))
    return flows.where(tls & ~inside).withColumn("mean", F.col("bytes") / F.greatest("packets", F.lit(1)))


def encrypted_exfil(flows: DataFrame, over: Table = TABLE) -> DataFrame:
    outward = has_private_prefix(F.col("src_ip")) & ~has_private_prefix(F.col("dst_ip"))
    upload = (F.col("received") <= 0) | (F.col("ratio") >= 0.85)
    # whole conversations are TLS or not, so the filter may come before their running sums
    seen = over.running_ratio(_tls(flows)).where(outward & (F.col("bytes") >= 5_000_000) & (F.col("mean") >= 1150) & upload)
    return fires(seen, "encrypted_exfil", "ANOMALOUS_TLS", F.lit("HIGH"), F.lit(0.91), 0, ["src_ip", "dst_ip", "dst_port"], F.col("bytes"))


def encrypted_beacon(flows: DataFrame, history: int = 20, least: int = 3, over: Table = TABLE) -> DataFrame:
    keys = ["src_ip", "dst_ip", "dst_port"]
    alike = F.col("mean").between(100, 500) & F.col("packets").between(4, 60)
    outward = has_private_prefix(F.col("src_ip")) & ~has_private_prefix(F.col("dst_ip"))
    seen = over.recent(_tls(flows), keys, history, alike, "n")
    seen = seen.where(outward & F.col("packets").between(5, 50) & F.col("mean").between(120, 480) & (F.col("n") >= least))
    return fires(seen, "encrypted_beacon", "ANOMALOUS_TLS", F.lit("HIGH"), F.lit(0.88), 0, keys, F.col("n"))


def baseline(flows: DataFrame, least: int = 10, z_from: float = 3.5, over: Table = TABLE) -> DataFrame:
    """Each row's deviation from its host's earlier rows: ``(flow_id, src_ip, n_before, z, unusual)``."""
    known = over.history(flows, ["src_ip"], "bytes", own=False)
    off = F.round((F.col("bytes") - F.col("mean_before")) / F.col("deviation_before"), 2)
    z = F.when((F.col("n_before") >= 5) & (F.col("deviation_before") > 1e-4), off).otherwise(0.0)
    found = known.select("flow_id", "src_ip", "n_before", z.alias("z"))
    return found.withColumn("unusual", (F.col("n_before") >= least) & (F.col("z") >= z_from))


#: The window detectors, in the order in which they see a flow.
DETECTORS = (port_scan, syn_flood, bandwidth_exfil, dns_volume, beaconing, lateral_movement, encrypted_exfil, encrypted_beacon)
