"""Declarative detection rules: a selection of field conditions, compiled to one column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.net import has_private_prefix

#: Rule levels and the severity of their alerts.
LEVELS = {"informational": "LOW", "low": "LOW", "medium": "MEDIUM", "high": "HIGH", "critical": "CRITICAL"}
COMPARE = re.compile(r"\s*(>=|<=|!=|==|>|<)\s*(.+?)\s*")
TECHNIQUE = re.compile(r"attack\.(t\d{4}(?:\.\d{3})?)", re.I)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    level: str
    selection: dict[str, object]
    tags: tuple[str, ...] = ()
    description: str = ""

    @property
    def technique(self) -> str:
        found = [m[1].upper() for t in self.tags if (m := TECHNIQUE.fullmatch(t))]
        return found[0] if found else "T1071"

    @property
    def tactic(self) -> str:
        found = [t.split(".", 1)[1] for t in self.tags if t.startswith("attack.") and not TECHNIQUE.fullmatch(t)]
        return found[0].replace("_", " ").title() if found else "Command And Control"


#: The three rules that come with the engine.
SHIPPED = (
    Rule(
        "9a8b7c6d-1122-3344-5566-778899aabb01",
        "Outbound Communication to Unusual C2 High Ports",
        "high",
        {"dst_port": [8080, 8443, 50050, 4444], "protocol": 6, "upload_ratio": "> 0.70", "direction": "outbound"},
        ("attack.command_and_control", "attack.t1071.001"),
    ),
    Rule(
        "9a8b7c6d-1122-3344-5566-778899aabb03",
        "DNS Anomalous Large Payload Exfiltration Channel",
        "high",
        {"dst_port": 53, "bytes": "> 5000"},
        ("attack.exfiltration", "attack.t1071.004"),
    ),
    Rule(
        "9a8b7c6d-1122-3344-5566-778899aabb02",
        "Suspicious SMB Named Pipe or PsExec Lateral Spread",
        "critical",
        {"dst_port": 445, "protocol": 6, "packets": "> 25"},
        ("attack.lateral_movement", "attack.t1021.002"),
    ),
)


def load_rule(text: str) -> Rule:
    """A rule from its YAML text: top-level scalars and lists, and the detection's selection.

    Only the subset of YAML that such rules use is read. ValueError without a title or a selection.
    """
    top: dict[str, object] = {}
    selection: dict[str, object] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while path and (path[-1][0] > indent or (path[-1][0] == indent and not body.startswith("- "))):
            path.pop()
        names = [n for _, n in path]
        inside = names[:2] == ["detection", "selection"]
        if body.startswith("- "):
            target = selection if inside else top
            name = names[-1] if names else ""
            target.setdefault(name, [])
            if isinstance(target[name], list):
                target[name].append(scalar(body[2:]))
            continue
        name, _, value = body.partition(":")
        name = name.strip()
        if not value.strip():
            path.append((indent, name))
        elif inside:
            selection[name] = scalar(value)
        elif not path:
            top[name] = scalar(value)
    if not top.get("title") or not selection:
        raise ValueError("a rule needs a title and a selection")
    return Rule(str(top.get("id", "")), str(top["title"]), str(top.get("level", "medium")), selection, tuple(map(str, top.get("tags", []))), str(top.get("description", "")))


def scalar(text: str) -> object:
    value = text.strip().strip("\"'")
    return int(value) if re.fullmatch(r"-?\d+", value) else float(value) if re.fullmatch(r"-?\d+\.\d+", value) else value


def _matches(column: Column, wanted: object) -> Column:
    if isinstance(wanted, list):
        return reduce(lambda a, b: a | b, [_matches(column, w) for w in wanted])
    text = column.cast("string")
    if isinstance(wanted, str) and (m := COMPARE.fullmatch(wanted)):
        number, bound = text.try_cast("double"), float(m[2])
        return {">=": number >= bound, "<=": number <= bound, "!=": number != bound, "==": number == bound, ">": number > bound, "<": number < bound}[m[1]]
    if isinstance(wanted, (int, float)):
        return text.try_cast("double") == float(wanted)
    return F.lower(text) == str(wanted).lower()


def condition(rule: Rule, columns: list[str]) -> Column:
    """All of the selection's fields match; a field that is not there or null does not."""
    parts = [_matches(F.col(k), v) if k in columns else F.lit(False) for k, v in rule.selection.items()]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def with_context(flows: DataFrame, upload_ratio: Column | None = None) -> DataFrame:
    """Flows with the derived fields that rules may name."""
    direction = F.when(has_private_prefix(F.col("dst_ip")), "internal").otherwise("outbound")
    ratio = F.lit(0.5) if upload_ratio is None else upload_ratio
    return flows.withColumns({"direction": direction, "upload_ratio": ratio})


def evaluate(flows: DataFrame, rules: tuple[Rule, ...] = SHIPPED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One alert row for each flow and rule that match, in one pass over the flows; ``keep`` names further columns of theirs."""
    hits = [
        F.when(
            condition(r, flows.columns),
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(LEVELS.get(r.level, "MEDIUM")).alias("severity"), F.lit(r.technique).alias("technique"), F.lit(r.tactic).alias("tactic")),
        )
        for r in rules
    ]
    found = flows.select("flow_id", "t_us", "src_ip", "dst_ip", "dst_port", *keep, F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select("flow_id", "t_us", "src_ip", "dst_ip", "dst_port", *keep, "hit.*", F.lit("ANOMALY_ML").alias("category"), F.lit(0.91).alias("confidence"))


