"""Counts, postures, heat maps and standard export formats of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.dims import SEVERITIES
from flowquarry.operators.hosts import lookup

#: Fixed values of the formats: severity numbers of CEF, OCSF and layers, OCSF status numbers, layer colours.
CEF_SEVERITY = {"LOW": 3, "MEDIUM": 5, "HIGH": 8, "CRITICAL": 10}
OCSF_SEVERITY = {"LOW": 2, "MEDIUM": 3, "HIGH": 4, "CRITICAL": 5}
OCSF_STATUS = {"NEW": 1, "INVESTIGATING": 2, "RESOLVED": 4, "FALSE_POSITIVE": 5}
LAYER_SCORE = {"LOW": 1, "MEDIUM": 3, "HIGH": 7, "CRITICAL": 10}
HEAT = {"LOW": 1, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
RISK = {"LOW": 1, "MEDIUM": 4, "HIGH": 12, "CRITICAL": 25}
VENDOR, PRODUCT = "flowquarry", "flowquarry"


def severity_counts(alerts: DataFrame) -> DataFrame:
    """All severities, with 0 for those without alerts."""
    every = alerts.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = alerts.groupBy("severity").agg(F.count("*").alias("alerts"))
    return every.join(counts, "severity", "left").select("severity", F.coalesce("alerts", F.lit(0).cast("long")).alias("alerts"))


def category_counts(alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    counts = alerts.groupBy("category").agg(F.count("*").alias("alerts"))
    return techniques.select("category").join(counts, "category", "left").select("category", F.coalesce("alerts", F.lit(0).cast("long")).alias("alerts"))


def with_techniques(alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    known = alerts.join(techniques, "category", "left")
    defaults = {"tactic": "Unknown", "technique_id": "T0000", "technique_name": "Unclassified Network Behavior"}
    return known.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def with_controls(alerts: DataFrame, controls: DataFrame) -> DataFrame:
    """Alerts with the list of requirements that their category bears on."""
    listed = controls.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "standard", "requirement_id"))), "; ").alias("requirements"))
    return alerts.join(listed, "category", "left")


def heat_map(alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    """Per category's technique: alerts, greatest heat, and up to ten sources and targets."""
    first_ten = lambda c: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, 10), ",")
    sums = alerts.groupBy("category").agg(
        F.count("*").alias("alerts"), F.max(lookup(F.col("severity"), HEAT, 1)).alias("heat"), first_ten("src_ip").alias("sources"), first_ten("dst_ip").alias("targets"), F.max("t_us").alias("last_us")
    )
    joined = techniques.select("category", "tactic", "technique_id").join(sums, "category", "left")
    return joined.select(
        "category", "tactic", "technique_id", F.coalesce("alerts", F.lit(0).cast("long")).alias("alerts"), F.coalesce("heat", F.lit(0)).alias("heat"),
        F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("targets", F.lit("")).alias("targets"), "last_us",
    )


def navigator(alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    """Rows of a technique layer: technique, greatest score, alerts."""
    return with_techniques(alerts, techniques).groupBy("technique_id").agg(F.max(lookup(F.col("severity"), LAYER_SCORE, 1)).alias("score"), F.count("*").alias("alerts"))


def navigator_layer(rows: DataFrame, name: str) -> DataFrame:
    """The whole layer as one JSON document; techniques are few by nature."""
    colour = F.when(F.col("score") >= 10, "#ff0000").when(F.col("score") >= 7, "#ff8800").when(F.col("score") >= 3, "#ffcc00").otherwise("#88cc00")
    item = F.struct(F.col("technique_id").alias("techniqueID"), "score", colour.alias("color"))
    listed = rows.agg(F.array_sort(F.collect_list(item)).alias("techniques"))
    versions = F.struct(F.lit("14").alias("attack"), F.lit("4.9.1").alias("navigator"), F.lit("4.5").alias("layer"))
    return listed.select(F.to_json(F.struct(F.lit(name).alias("name"), versions.alias("versions"), F.lit("enterprise-attack").alias("domain"), "techniques")).alias("layer"))


def posture(alerts: DataFrame, *by: str) -> DataFrame:
    """The compliance score of unresolved alerts and what it means for the standards, in one row or in one for each group ``by``."""
    unresolved = F.col("status") != "RESOLVED"
    n = alerts.groupBy(*by).agg(*[F.count_if(unresolved & (F.col("severity") == s)).cast("long").alias(s.lower()) for s in ("CRITICAL", "HIGH")])
    score = F.greatest(F.lit(0).cast("long"), 100 - 15 * F.col("critical") - 5 * F.col("high"))
    return n.select(
        *by, "critical", "high", score.alias("score"), F.when(score >= 90, "EXCELLENT").when(score >= 70, "DEGRADED").otherwise("CRITICAL").alias("level"),
        F.when(F.col("critical") > 0, "AT_RISK").otherwise("COMPLIANT").alias("pci"), F.when(F.col("high") > 2, "NEEDS_REVIEW").otherwise("COMPLIANT").alias("iso"),
    )


def executive(alerts: DataFrame, flows: DataFrame, *by: str) -> DataFrame:
    """Open risk from 0 to 100, its label, and the traffic behind it, in one row or in one for each group ``by`` that has flows."""
    open_ = F.col("status").isin("NEW", "INVESTIGATING")
    risk = alerts.groupBy(*by).agg(
        F.least(F.lit(100), F.coalesce(F.sum(F.when(open_, lookup(F.col("severity"), RISK, 0))), F.lit(0))).cast("long").alias("risk"),
        F.count_if(open_ & (F.col("severity") == "CRITICAL")).alias("critical"),
        F.count_if(open_).alias("open_alerts"),
    )
    traffic = flows.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"), F.count("*").alias("flows"))
    label = F.when((F.col("risk") >= 60) | (F.col("critical") > 0), "CRITICAL").when(F.col("risk") >= 25, "HIGH").when(F.col("risk") >= 10, "MEDIUM").otherwise("LOW")
    if by:
        both = traffic.join(risk, list(by), "left").fillna(0, ["risk", "critical", "open_alerts"])
    else:
        both = risk.crossJoin(F.broadcast(traffic))
    return both.select(*by, "risk", (100 - F.col("risk")).alias("posture"), label.alias("label"), "critical", "open_alerts", "bytes", "packets", "flows")


def _protocol(protocol: Column) -> Column:
    return F.when(protocol == 6, "TCP").when(protocol == 17, "UDP").otherwise(protocol.cast("string"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("="), F.lit("\\="))


def cef(alerts: DataFrame) -> DataFrame:
    """``(alert_id, cef)``. Alerts have title, description, tactic and technique_id."""
    parts = {
        "src": F.col("src_ip"),
        "dst": F.col("dst_ip"),
        "dpt": F.col("dst_port"),
        "proto": _protocol(F.col("protocol")),
        "msg": escaped(F.col("description")),
        "cs1": F.col("status"),
        "cs1Label": F.lit("IncidentStatus"),
        "cfp1": F.col("confidence"),
        "cfp1Label": F.lit("ConfidenceScore"),
        "cs2": F.col("technique_id"),
        "cs2Label": F.lit("MitreTechniqueId"),
        "cs3": F.col("tactic"),
        "cs3Label": F.lit("MitreTactic"),
    }
    extension = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit(VENDOR), F.lit(PRODUCT), F.lit("1.0.0"), "category", escaped(F.col("title")), lookup(F.col("severity"), CEF_SEVERITY, 5).cast("string"))
    return alerts.select("alert_id", F.concat_ws("|", head, extension).alias("cef"))


def syslog(alerts: DataFrame) -> DataFrame:
    """``(alert_id, line)`` after RFC 5424, around the CEF text."""
    priority = F.when(F.col("severity") == "CRITICAL", 34).when(F.col("severity") == "HIGH", 35).otherwise(36)
    stamp = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    joined = alerts.join(cef(alerts), "alert_id")
    line = F.concat(F.lit("<"), priority, F.lit(">1 "), stamp, F.lit(" sensor engine - ID"), F.substring("alert_id", 1, 8), F.lit(' [alert@5424 tenant="'), "tenant_id", F.lit('"] '), "cef")
    return joined.select("alert_id", line.alias("line"))


def ocsf(alerts: DataFrame) -> DataFrame:
    """``(alert_id, ocsf)``: class 2001 findings as JSON."""
    s = F.struct
    attack = s(F.lit("v14.1").alias("version"), s(F.col("tactic").alias("name")).alias("tactic"), s(F.col("technique_id").alias("uid"), F.col("technique_name").alias("name")).alias("technique"))
    body = s(
        F.lit(2001).alias("class_uid"),
        F.lit(2).alias("category_uid"),
        F.lit(1).alias("activity_id"),
        F.floor(F.col("t_us") / 1_000_000).cast("long").alias("time"),
        lookup(F.col("severity"), OCSF_SEVERITY, 3).alias("severity_id"),
        lookup(F.col("status"), OCSF_STATUS, 1).alias("status_id"),
        F.floor(F.col("confidence") * 100 + 1e-9).cast("int").alias("confidence_score"),
        s(F.col("alert_id").alias("uid"), F.col("title").alias("title"), F.array("category").alias("types")).alias("finding_info"),
        F.array(attack).alias("attacks"),
        s(
            F.col("protocol").alias("protocol_num"), _protocol(F.col("protocol")).alias("protocol_name"),
            s(F.col("src_ip").alias("ip")).alias("src_endpoint"), s(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port")).alias("dst_endpoint"),
        ).alias("network_activity"),
        s(F.lit("1.1.0").alias("version"), F.col("tenant_id").alias("tenant_id")).alias("metadata"),
    )
    return alerts.select("alert_id", F.to_json(body).alias("ocsf"))
