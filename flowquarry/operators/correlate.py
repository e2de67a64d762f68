"""Alerts to campaigns: kill-chain stages in a window, and Bayesian cases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.operators.detect import swept
from flowquarry.operators.graph import components
from flowquarry.operators.hosts import lookup
from flowquarry.sources.cut import stored

#: Stages of the window correlator.
STAGES = {
    "PORT_SCAN": "1_RECONNAISSANCE",
    "ANOMALY_ML": "1_RECONNAISSANCE",
    "MALICIOUS_C2": "2_COMMAND_AND_CONTROL",
    "C2_BEACONING": "2_COMMAND_AND_CONTROL",
    "DNS_TUNNEL": "2_COMMAND_AND_CONTROL",
    "LATERAL_MOVEMENT": "2_LATERAL_MOVEMENT",
    "EXFILTRATION": "3_ACTIONS_ON_OBJECTIVES",
    "SYN_FLOOD": "3_ACTIONS_ON_OBJECTIVES",
}
#: Stages of the Bayesian correlator; other categories are reconnaissance.
CASE_STAGES = {
    "PORT_SCAN": "RECONNAISSANCE",
    "SYN_FLOOD": "IMPACT",
    "LATERAL_MOVEMENT": "LATERAL_MOVEMENT",
    "IDENTITY_ATTACK": "CREDENTIAL_ACCESS",
    "MALICIOUS_C2": "COMMAND_AND_CONTROL",
    "C2_BEACONING": "COMMAND_AND_CONTROL",
    "ANOMALOUS_TLS": "COMMAND_AND_CONTROL",
    "DGA_DOMAIN": "COMMAND_AND_CONTROL",
    "EXFILTRATION": "EXFILTRATION",
    "DNS_TUNNEL": "EXFILTRATION",
}
#: Probability of a stage after another one, and what a severity says.
FOLLOWS = {
    ("RECONNAISSANCE", "INITIAL_ACCESS"): 0.65,
    ("RECONNAISSANCE", "LATERAL_MOVEMENT"): 0.70,
    ("RECONNAISSANCE", "CREDENTIAL_ACCESS"): 0.50,
    ("INITIAL_ACCESS", "LATERAL_MOVEMENT"): 0.80,
    ("INITIAL_ACCESS", "CREDENTIAL_ACCESS"): 0.75,
    ("INITIAL_ACCESS", "COMMAND_AND_CONTROL"): 0.85,
    ("LATERAL_MOVEMENT", "CREDENTIAL_ACCESS"): 0.85,
    ("LATERAL_MOVEMENT", "COMMAND_AND_CONTROL"): 0.75,
    ("LATERAL_MOVEMENT", "EXFILTRATION"): 0.65,
    ("CREDENTIAL_ACCESS", "LATERAL_MOVEMENT"): 0.80,
    ("CREDENTIAL_ACCESS", "COMMAND_AND_CONTROL"): 0.85,
    ("CREDENTIAL_ACCESS", "EXFILTRATION"): 0.90,
    ("COMMAND_AND_CONTROL", "LATERAL_MOVEMENT"): 0.70,
    ("COMMAND_AND_CONTROL", "EXFILTRATION"): 0.95,
    ("COMMAND_AND_CONTROL", "IMPACT"): 0.80,
    ("EXFILTRATION", "IMPACT"): 0.60,
}
OTHERWISE = 0.40
LIKELIHOOD = {"LOW": 1.5, "MEDIUM": 2.5, "HIGH": 4.5, "CRITICAL": 8.0}
PRIOR, IDLE_S, ESCALATE_AT = 0.05, 1800, 0.85


def kill_chain(alerts: DataFrame, seconds: float = 900) -> DataFrame:
    """The first alert at which a source has a set of two or more stages in the window, for each such set.

    Stages are few, so a window's set is told by a running count for each: see ``detect.swept``.
    """
    staged = alerts.where("category <> 'ATTACK_CAMPAIGN'").withColumn("stage", lookup(F.col("category"), STAGES, None))
    names = sorted(set(STAGES.values()))
    counts = {f"stage_{i}": F.col("stage").eqNullSafe(name).cast("int") for i, name in enumerate(names)}
    slim = staged.select("src_ip", "t_us", "alert_id", *[c.alias(f"is_{n}") for n, c in counts.items()])
    seen = swept(slim, ["src_ip"], seconds, {"n_alerts": F.lit(1)} | {n: F.col(f"is_{n}") for n in counts})
    stages = F.array_compact(F.array(*[F.when(F.col(f"stage_{i}") > 0, F.lit(name)) for i, name in enumerate(names)]))
    seen = seen.withColumn("stages", stages).where(F.size("stages") >= 2)
    first = seen.groupBy("src_ip", "stages").agg(F.min(F.struct("t_us", "alert_id", "n_alerts")).alias("at"))
    return first.select("src_ip", "at.t_us", "at.alert_id", F.array_join("stages", " -> ").alias("progression"), "at.n_alerts")


def update(probability: float, severity: str, before: str | None, stage: str) -> float:
    """A case's probability after one more alert."""
    weight = LIKELIHOOD.get(severity, 2.0)
    if before is not None and before != stage:
        weight *= 1 + 0.5 * FOLLOWS.get((before, stage), OTHERWISE)
    p = min(0.999, max(0.01, probability))
    odds = p / (1 - p) * weight
    return min(0.999, round(odds / (1 + odds), 4))


def case_groups(alerts: DataFrame, idle_us: int = IDLE_S * 1_000_000) -> DataFrame:
    """``alerts`` with ``group``, and ``seen``: whether the source was at an end of an earlier alert of its tenant.

    Alerts of different groups never meet in a case. Alerts that share a host within the idle time are one group; then an alert of a
    host joins the group of the host's last alert as well if that group, by other hosts, went on to within the idle time; and so on until no group grows.
    """
    order = Window.partitionBy("scope", "ip").orderBy("t_us", "alert_id")
    valid = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "0.0.0.0")
    alone = F.concat(F.lit("#"), F.col("alert_id"))  # an end that is no address meets nothing
    ends = F.array_compact(
        F.array(
            F.struct(F.when(valid("src_ip"), F.col("src_ip")).otherwise(alone).alias("ip"), F.lit(True).alias("is_source")),
            F.when(valid("dst_ip") & ~F.col("dst_ip").eqNullSafe(F.col("src_ip")), F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("is_source"))),
        )
    )
    met = alerts.withColumn("scope", F.coalesce("tenant_id", F.lit(""))).select("*", F.explode(ends).alias("end")).select("*", "end.*").drop("end")
    met = met.withColumns({"before": F.lag("alert_id").over(order), "pause_us": F.col("t_us") - F.lag("t_us").over(order)})
    opens = F.when(F.coalesce(F.col("pause_us") > idle_us, F.lit(True)), F.col("alert_id"))
    met = stored(met.withColumn("episode", F.last(opens, ignorenulls=True).over(order)), "sightings")
    found = components(met.select(F.col("alert_id").alias("a"), F.col("episode").alias("b")))
    later = met.where(F.col("pause_us") > idle_us).select("alert_id", "before", "t_us")
    rows = met.where("is_source").drop("ip", "is_source", "episode", "pause_us").withColumnRenamed("before", "seen")
    while True:
        names = found.select(F.col("node").alias("alert_id"), F.col("component").alias("group"))
        grouped = stored(rows.join(names, "alert_id", "left").withColumns({"group": F.coalesce("group", "alert_id"), "seen": F.col("seen").isNotNull()}), "case-groups")
        spans = grouped.groupBy("group").agg(F.max("t_us").alias("until_us"))
        of = grouped.select("alert_id", "group")
        ends = later.join(of, "alert_id").join(of.select(F.col("alert_id").alias("before"), F.col("group").alias("past")), "before")
        touching = ends.join(spans.withColumnRenamed("group", "past"), "past").where((F.col("group") != F.col("past")) & (F.col("t_us") - F.col("until_us") <= idle_us))
        more = stored(touching.select(F.col("group").alias("a"), F.col("past").alias("b")).distinct(), "group-links")
        if not more.limit(1).count():
            return grouped.drop("scope")
        merged = components(more).select(F.col("node").alias("group"), "component")
        found = grouped.join(merged, "group", "left").select(F.col("alert_id").alias("node"), F.coalesce("component", "group").alias("component"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Alerts in time order, group by group, to cases.

    A source that was seen before but has no open case opens a new one; one never seen joins the open case of
    its destination. Addresses of cases that went idle are forgotten whenever the cases held have doubled.
    """
    place, cases, case_of, held = None, {}, {}, 1000
    for batch in batches:
        rows = []
        for a in batch.itertuples(index=False):
            if (a.tenant_id, a.group) != place:
                place, cases, case_of, held = (a.tenant_id, a.group), {}, {}, 1000
            if len(cases) > held:
                cases = {k: c for k, c in cases.items() if a.t_us - c["t"] <= IDLE_S * 1_000_000}
                case_of = {ip: k for ip, k in case_of.items() if k in cases}
                held = max(1000, 2 * len(cases))
            stage = CASE_STAGES.get(a.category, "RECONNAISSANCE")
            name = case_of.get(a.src_ip) or (None if a.seen else case_of.get(a.dst_ip))
            case = cases.get(name)
            if case is None or a.t_us - case["t"] > IDLE_S * 1_000_000:
                name = f"{a.tenant_id}/{a.alert_id}"
                case = cases[name] = {"p": PRIOR, "stages": set(), "last": None, "done": False, "t": 0, "asset": a.src_ip, "n": 0}
            for ip in (a.src_ip, a.dst_ip):
                if ip and ip != "0.0.0.0":
                    case_of[ip] = name
            case["p"] = update(case["p"], a.severity, case["last"], stage)
            case["stages"].add(stage)
            case.update(last=stage, t=a.t_us, n=case["n"] + 1)
            escalates = not case["done"] and len(case["stages"]) >= 2 and case["p"] >= ESCALATE_AT
            case["done"] = case["done"] or escalates
            rows.append((a.tenant_id, a.alert_id, a.t_us, name, case["asset"], stage, case["n"], len(case["stages"]), case["p"], escalates))
        yield pd.DataFrame(rows, columns=["tenant_id", "alert_id", "t_us", "case_id", "asset", "stage", "n_alerts", "n_stages", "probability", "escalates"])


def cases(alerts: DataFrame) -> DataFrame:
    """Each alert with its case and the case's state after it.

    An alert joins the open case of its source, else of its destination, unless that is idle for half an
    hour; so order matters within a group of :func:`case_groups`. Groups go to different tasks; each is streamed in
    time order by one, which holds its open cases.
    """
    cut = case_groups(alerts.select("tenant_id", "alert_id", "t_us", "src_ip", "dst_ip", "category", "severity"))
    ordered = cut.repartition("tenant_id", "group").sortWithinPartitions("tenant_id", "group", "t_us", "alert_id")
    schema = "tenant_id string, alert_id string, t_us long, case_id string, asset string, stage string, n_alerts int, n_stages int, probability double, escalates boolean"
    return ordered.mapInPandas(_fold, schema)


def case_list(case_rows: DataFrame, status: str | None = None) -> DataFrame:
    """Cases by falling probability, with their status."""
    last = F.struct("t_us", "n_alerts")
    out = case_rows.groupBy("case_id").agg(
        F.max_by("probability", last).alias("probability"), F.max_by("n_stages", last).alias("n_stages"), F.max("n_alerts").alias("n_alerts"), F.bool_or("escalates").alias("escalated")
    )
    out = out.withColumn("status", F.when(F.col("escalated"), "ESCALATED").otherwise("OPEN")).drop("escalated")
    return (out if status is None else out.where(F.col("status") == status.upper())).orderBy(F.desc("probability"), "case_id")
