"""Keyed state of flow streams: rows of a key are folded in the order of their times, once the watermark says that no earlier one comes.

The window detectors of :mod:`flowquarry.operators.detect` are written over four folds: sums over a look-back window, a
key's history, a conversation's volumes and a key's last rows. There they are window expressions over a table; here they
are the same figures over a stream, so a detector is one definition for both. A stream needs the RocksDB state store.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from flowquarry.functions.net import canonical_pair
from flowquarry.operators import biflow, detect
from flowquarry.operators.analytics import bytes_ratio

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_TIME = "ts"


def use_state_store(spark) -> None:
    """Let the session keep state in RocksDB, which timers and lists of keyed state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class Fold:
    """What a key remembers and how rows change it. ``rows`` come in order; rows of one time may come together.

    ``schema`` is that of the memory, a tuple; ``until`` is the time in microseconds after which the memory makes no
    difference any more, or None where it always does.
    """

    schema = ""
    #: Whether the fold makes whole rows, any number of them, instead of values to put behind each.
    whole = False

    def fold(self, memory: tuple | None, rows: list[Row]) -> tuple[tuple | None, list[tuple | None]]:
        """The new memory, and for each row the values that are put behind it, or None where the row goes."""
        raise NotImplementedError

    def until(self, memory: tuple) -> int | None:
        return None

    def left(self, memory: tuple) -> list[tuple]:
        """Whole rows that come out when the memory goes."""
        return []


class InOrder(StatefulProcessor):
    """Hands each key's rows to a fold in the order of ``t_us`` and ``flow_id``, as far as the watermark has come.

    Rows wait in state until then. Timers wake a key for its earliest waiting row, and for the time when its memory
    may go: a quiet key leaves no state behind.
    """

    def __init__(self, fold: Fold, waiting: T.StructType, made: T.StructType):
        self.folding, self.schema = fold, waiting
        self.row, self.made = Row(*waiting.names), Row(*made.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.memory = handle.getValueState("memory", self.folding.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._advance(list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, new: list[Row], watermark_ms: int) -> Iterator[Row]:
        held = [self.row(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted([*held, *new], key=lambda r: (r["t_us"], r["flow_id"]))
        due = [r for r in rows if r["t_us"] <= watermark_ms * 1000]
        rest = rows[len(due) :]
        memory = self.memory.get() if self.memory.exists() else None
        made: list[tuple | None] = []
        last: list[tuple] = []
        if due:
            memory, made = self.folding.fold(memory, due)
        wake = []
        if rest:
            wake.append(ceil(rest[0]["t_us"] / 1000) - 1)
        if memory is not None and (until := self.folding.until(memory)) is not None:
            if until < watermark_ms * 1000:
                last, memory = self.folding.left(memory), None
            else:
                wake.append(until // 1000 + 1)
        if due or len(rest) != len(held):
            if rest:
                self.waiting.put([tuple(r) for r in rest])
            elif held:
                self.waiting.clear()
        if memory is not None:
            self.memory.update(memory)
        elif self.memory.exists():
            self.memory.clear()
        known = set(self.handle.listTimers())  # those that have expired are being gone through, and go by themselves
        for at in known - set(wake):
            if at > watermark_ms:
                self.handle.deleteTimer(at)
        for at in set(wake) - known:
            self.handle.registerTimer(max(at, watermark_ms))
        if self.folding.whole:
            yield from (self.made(*values) for values in made)
        else:
            yield from (self.made(*row, *values) for row, values in zip(due, made, strict=True) if values is not None)
        yield from (self.made(*values) for values in last)

    def close(self) -> None:
        pass


def folded(rows: DataFrame, keys: list[str], fold: Fold, extra: str, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` by ``keys`` through a fold, with its values as the columns ``extra`` behind them, less the columns ``dropped``."""
    added = T._parse_datatype_string(extra) if extra else T.StructType()
    out = T.StructType([*rows.schema.fields, *added.fields])
    found = rows.groupBy(*keys).transformWithState(InOrder(fold, rows.schema, out), out, "Append", "EventTime", eventTimeColumnName=EVENT_TIME)
    return found.drop(*dropped)


class Window(Fold):
    """Sums, counts of distinct values and figures of gaps over the closed look-back window, as in ``detect.swept``."""

    schema = "times array<long>, sums array<array<long>>, items array<array<string>>, gap_ends array<long>, gap_starts array<long>, last long"

    def __init__(self, width_us: int, sums: list[str], distinct: list[str], gaps: tuple[int, int] | None):
        self.width, self.sums, self.distinct, self.gaps = width_us, sums, distinct, gaps

    def until(self, memory: tuple) -> int:
        return (memory[0] or [memory[5]])[-1] + self.width

    def fold(self, memory, rows):
        times, sums, items, gap_ends, gap_starts, last = memory if memory is not None else ([], [], [], [], [], None)
        held = deque(zip(times, map(tuple, sums), map(tuple, items), strict=True))
        gaps = deque(zip(gap_starts, gap_ends, strict=True))
        totals = [sum(h[1][i] for h in held) for i in range(len(self.sums))]
        counts = [Counter(h[2][i] for h in held if h[2][i] is not None) for i in range(len(self.distinct))]
        made, at = [], 0
        while at < len(rows):
            t = rows[at]["t_us"]
            end = at
            while end < len(rows) and rows[end]["t_us"] == t:  # rows of one time see each other
                row = rows[end]
                values, things = tuple(row[c] or 0 for c in self.sums), tuple(row[c] for c in self.distinct)
                held.append((t, values, things))
                for i, v in enumerate(values):
                    totals[i] += v
                for i, d in enumerate(things):
                    if d is not None:
                        counts[i][d] += 1
                if self.gaps and last is not None and self.gaps[0] < t - last <= self.gaps[1]:
                    gaps.append((last, t))
                last, end = t, end + 1
            while held[0][0] < t - self.width:
                _, values, things = held.popleft()
                for i, v in enumerate(values):
                    totals[i] -= v
                for i, d in enumerate(things):
                    if d is not None:
                        counts[i][d] -= 1
                        if not counts[i][d]:
                            del counts[i][d]
            while gaps and gaps[0][0] < t - self.width:
                gaps.popleft()
            lengths = [b - a for a, b in gaps] if self.gaps else []
            figures = (len(lengths), sum(lengths), sum(g * g for g in lengths)) if self.gaps else ()
            made += [(*totals, *map(len, counts), *figures)] * (end - at)
            at = end
        memory = ([h[0] for h in held], [list(h[1]) for h in held], [list(h[2]) for h in held], [b for _, b in gaps], [a for a, _ in gaps], last)
        return memory, made


class History(Fold):
    """Number, mean and deviation of a value over a key's rows so far, the row itself included or not."""

    schema = "n long, mean double, squares double"

    def __init__(self, value: str, own: bool):
        self.value, self.own = value, own

    def fold(self, memory, rows):
        n, mean, squares = memory or (0, 0.0, 0.0)
        made = []
        for row in rows:
            before = (n, mean if n else None, sqrt(max(squares, 0.0) / (n - 1)) if n > 1 else None)
            value = row[self.value]
            if value is not None:
                n += 1
                off = value - mean
                mean += off / n
                squares += off * (value - mean)
            made.append((n, mean if n else None, sqrt(max(squares, 0.0) / (n - 1)) if n > 1 else None) if self.own else before)
        return (n, mean, squares), made


class Volumes(Fold):
    """Bytes each way of a conversation as of each row; its memory may go after a quiet time."""

    schema = "ip string, port int, sent long, received long, last long"

    def __init__(self, quiet_us: int | None):
        self.quiet = quiet_us

    def until(self, memory):
        return None if self.quiet is None else memory[4] + self.quiet

    def fold(self, memory, rows):
        made = []
        for row in rows:
            if memory is not None and self.quiet is not None and row["t_us"] > memory[4] + self.quiet:
                memory = None
            ip, port, sent, received, _ = memory or (row["opener_ip"], row["opener_port"], 0, 0, 0)
            out = (row["src_ip"], row["src_port"]) == (ip, port)
            sent, received = sent + (row["bytes"] or 0) * out, received + (row["bytes"] or 0) * (not out)
            memory = (ip, port, sent, received, row["t_us"])
            made.append((sent, received))
        return memory, made


class Recent(Fold):
    """The sum of a value over a key's last rows."""

    schema = "values array<long>"

    def __init__(self, value: str, rows: int):
        self.value, self.rows = value, rows

    def fold(self, memory, rows):
        held, made = deque(memory[0] if memory else [], self.rows), []
        for row in rows:
            held.append(row[self.value] or 0)
            made.append((sum(held),))
        return (list(held),), made


class Cooldown(Fold):
    """Rows that come a cooldown after the last one kept of their detector and key."""

    schema = "last long, cooldown_us long"

    def until(self, memory):
        return memory[0] + memory[1]

    def fold(self, memory, rows):
        last, made = memory[0] if memory else None, []
        for row in rows:
            pause = int(row["cooldown_s"] * 1_000_000)
            fresh = last is None or row["t_us"] - last >= pause
            if fresh:
                last, memory = row["t_us"], (row["t_us"], pause)
            made.append(() if fresh else None)
        return memory, made


class Exports(Fold):
    """A probe's flow of one 5-tuple, as in ``analytics.packet_exports``: exports at every so many packets, at its end and when it is idle."""

    schema = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, packets long, bytes long, tcp_flags int, first_us long, last_us long"
    whole = True

    def __init__(self, idle_us: int, every: int):
        self.idle, self.every = idle_us, every

    def until(self, memory):
        return memory[-1] + self.idle - 1

    def left(self, memory):
        return [(*memory, "IDLE")]

    def fold(self, memory, rows):
        made = []
        for row in rows:
            if memory is not None and row["t_us"] - memory[-1] >= self.idle:
                made += self.left(memory)
                memory = None
            closes = memory is not None and row["tcp_flags"] & 5
            old = memory or (*(row[c] for c in EXPORT_KEYS), 0, 0, 0, row["t_us"], 0)
            memory = (*old[:5], old[5] + 1, old[6] + row["bytes"], old[7] | row["tcp_flags"], old[8], row["t_us"])
            if closes or memory[5] % self.every == 0:
                made.append((*memory, "END" if closes else "COUNT"))
            memory = None if closes else memory
        return memory, made


EXPORT_KEYS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")


def packet_exports(packets: DataFrame, idle_seconds: int = 15, every: int = 50, late: str = "10 seconds") -> DataFrame:
    """``analytics.packet_exports`` of packets as they come; a tuple's state is its open flow, and goes with it."""
    use_state_store(packets.sparkSession)
    cut = packets.select(*EXPORT_KEYS, "t_us", "flow_id", "bytes", "tcp_flags", EVENT_TIME).withWatermark(EVENT_TIME, late)
    out = T._parse_datatype_string(f"{Exports.schema}, reason string")
    processor = InOrder(Exports(idle_seconds * 1_000_000, every), cut.schema, out)
    return cut.groupBy(*EXPORT_KEYS).transformWithState(processor, out, "Append", "EventTime")


class Stream:
    """The folds behind the window detectors, over a stream with a watermark on ``ts``."""

    def __init__(self, forget_conversations_s: float | None = None):
        self.quiet_us = None if forget_conversations_s is None else int(forget_conversations_s * 1_000_000)

    def swept(self, rows: DataFrame, keys: list[str], seconds: float, sums: dict[str, Column] | None = None, distinct: dict[str, str] | None = None, gaps: tuple[float, float] | None = None) -> DataFrame:
        sums, distinct = sums or {}, distinct or {}
        plus = {f"plus_{n}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for n, v in sums.items()} | {f"item_{n}": F.col(c).cast("string") for n, c in distinct.items()}
        ranges = None if gaps is None else (int(gaps[0] * 1_000_000), int(gaps[1] * 1_000_000))
        window = Window(int(seconds * 1_000_000), [f"plus_{n}" for n in sums], [f"item_{n}" for n in distinct], ranges)
        extra = ", ".join(f"{n} long" for n in [*sums, *distinct, *(detect.GAP_FIGURES if gaps else ())])
        return folded(rows.withColumns(plus), keys, window, extra, tuple(plus))

    def history(self, rows: DataFrame, keys: list[str], value: str, own: bool) -> DataFrame:
        return folded(rows, keys, History(value, own), "n_before long, mean_before double, deviation_before double")

    def running_ratio(self, rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
        low, high = canonical_pair(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
        ends = {f"{end}_{part}": of[part] for end, of in (("low", low), ("high", high), ("opener", biflow.opener())) for part in ("ip", "port")}
        keys = ["low_ip", "low_port", "high_ip", "high_port", "protocol"]  # keys with structs cannot wake on timers
        summed = folded(rows.withColumns(ends), keys, Volumes(self.quiet_us), "sent long, received long", tuple(ends))
        return summed.withColumn("ratio", bytes_ratio(F.col("sent"), F.col("received")))

    def recent(self, rows: DataFrame, keys: list[str], n: int, value: Column, name: str) -> DataFrame:
        return folded(rows.withColumn("recent_value", value.cast("long")), keys, Recent("recent_value", n), f"{name} long", ("recent_value",))


def alerts(flows: DataFrame, detector, late: str = "10 seconds", forget_conversations_s: float | None = None, **settings) -> DataFrame:
    """The alerts of one window detector of :mod:`flowquarry.operators.detect` as flows come, after its cooldown.

    They are those of the same flows as a table, but for flows later than ``late`` behind the newest, which are
    dropped. Newest counts among the flows that the detector looks at, as Spark filters first; a row comes out once a later one of these is seen. State is a key's last window and its last alert, and goes when the key is quiet; the deviation in
    ``bandwidth_exfil`` keeps one row per source, and volumes one row per conversation, that goes after
    ``forget_conversations_s`` of quiet if that is given.
    """
    use_state_store(flows.sparkSession)
    fired = detector(flows.withWatermark(EVENT_TIME, late), over=Stream(forget_conversations_s), **settings)
    return folded(fired, ["detector", "key"], Cooldown(), "")
