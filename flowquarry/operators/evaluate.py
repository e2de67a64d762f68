"""How well alerts find labelled attacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(empty)


def confusion(rows: DataFrame) -> DataFrame:
    """One row of counts and rates from ``rows(is_malicious, alerted)``; empty precision and recall count as 1, F1 and FPR as 0."""
    bad, found = F.col("is_malicious"), F.col("alerted")
    n = rows.agg(
        F.count_if(bad & found).cast("long").alias("tp"), F.count_if(~bad & found).cast("long").alias("fp"), F.count_if(bad & ~found).cast("long").alias("fn"), F.count_if(~bad & ~found).cast("long").alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp, 1.0), _ratio(tp, tp + fn, 1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return n.select("tp", "fp", "fn", "tn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round(_ratio(fp, fp + tn, 0.0), 4).alias("fpr"))


def first_matches(vectors: DataFrame, alerts: DataFrame) -> DataFrame:
    """Each attack vector with its first alert: by vector id, or by attacker or target address.

    The three conditions are three equality joins, whose results are united; no pair is compared otherwise.
    """
    a = alerts.select("alert_id", "t_us", "severity", "category", F.col("vector_id").alias("a_vector"), F.col("src_ip").alias("a_src"), F.col("dst_ip").alias("a_dst"))
    out = None
    for left, right in (("vector_id", "a_vector"), ("attacker_ip", "a_src"), ("target_ip", "a_dst")):
        one = vectors.join(a, vectors[left] == a[right]).select("vector_id", "alert_id", "t_us", "severity", "category")
        out = one if out is None else out.union(one)
    w = Window.partitionBy("vector_id").orderBy("t_us", "alert_id")
    first = out.distinct().withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return vectors.join(first, "vector_id", "left")


def campaign_metrics(matched: DataFrame) -> DataFrame:
    """Detection rate, severity accuracy over all vectors, and time to detection in ms."""
    found = F.col("alert_id").isNotNull()
    delay = (F.col("t_us") - F.col("started_us")) / 1000.0
    n = F.count("*")
    return matched.agg(
        n.alias("vectors"),
        F.round(F.count_if(found) / n, 4).alias("recall"),
        F.round(F.count_if(found & (F.col("severity") == F.col("expected_severity"))) / n, 4).alias("severity_accuracy"),
        F.round(F.avg(delay), 3).alias("mttd_mean"),
        F.round(F.min(delay), 3).alias("mttd_min"),
        F.round(F.max(delay), 3).alias("mttd_max"),
    )


def evidence(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """``(alert_id, flow_id)``: flows with the alert's source or the alert's destination, each once."""
    a, f = alerts.select("alert_id", F.col("src_ip").alias("a_src"), F.col("dst_ip").alias("a_dst")), flows.select("flow_id", "src_ip", "dst_ip")
    by_source = f.join(a, f.src_ip == a.a_src).select("alert_id", "flow_id")
    by_target = f.join(a, (f.dst_ip == a.a_dst) & (f.src_ip != a.a_src)).select("alert_id", "flow_id")
    return by_source.union(by_target)


def evidence_counts(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """``(alert_id, flows, bytes)``: how many flows :func:`evidence` lists for each alert, and their bytes.

    From sums by source, by destination and by pair of both, so no pair of alert and flow is made.
    """
    sums = [F.count("*").alias("n"), F.sum("bytes").alias("b")]

    def by(short: str, *keys: str) -> DataFrame:
        return flows.groupBy(*keys).agg(*[s.alias(f"{short}_{c}") for s, c in zip(sums, ("n", "b"), strict=True)])

    joined = alerts.join(by("s", "src_ip"), "src_ip", "left").join(by("d", "dst_ip"), "dst_ip", "left").join(by("p", "src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left")
    total = lambda c: F.coalesce(f"s_{c}", F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0)) - F.coalesce(f"p_{c}", F.lit(0))
    return joined.select("alert_id", total("n").alias("flows"), total("b").alias("bytes"))
