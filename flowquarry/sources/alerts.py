"""Alert tables over the flow view, for queries on alerts: one alert for every flow, and one for each flow that looks odd by itself.

Odd are probes of high ports, large transfers and long names. So most flows have no odd alert, some attacks go unseen and some
plain flows are reported, for queries that compare alerts with flows. Severities, categories and states are dealt out, so that each occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators.dims import MITRE, SEVERITIES
from flowquarry.sources.flows import flow_view

STATUSES = ("NEW", "INVESTIGATING", "RESOLVED", "FALSE_POSITIVE")
CATEGORIES = tuple(m[0] for m in MITRE)


def _pick(values: tuple[str, ...], number: str) -> str:
    return "case " + " ".join(f"when {number} = {n} then '{v}'" for n, v in enumerate(values)) + " end"


#: The projection in any SQL engine; ``{text}`` is its type for strings.
PROJECTION = (
    "select cast(flow_id as {text}) as alert_id, t_us, "
    + _pick(SEVERITIES, "(flow_id % 7) % 4")
    + " as severity, "
    + _pick(CATEGORIES, "(flow_id % 17) % 13")
    + " as category, "
    + _pick(STATUSES, "(flow_id % 23) % 4")
    + " as status, concat('Alert ', cast(flow_id as {text})) as title, 'a|b=c' as description, src_ip, dst_ip, dst_port, protocol, "
    "cast(80 + flow_id % 20 as double) / 100 as confidence, tenant_id, cast(null as {text}) as campaign_id, cast(flow_id % 5 as {text}) as vector_id "
    "from {flows}"
)
ODD = "(tcp_flags & 18 = 2 and packets <= 4 and dst_port >= 1000) or bytes >= 5000000 or length(domain) >= 21"
ALERTS_SQL = f", alerts as ({PROJECTION.format(text='varchar', flows='flows')})"
ODD_ALERTS_SQL = f", alerts as ({PROJECTION.format(text='varchar', flows='flows')} where {ODD})"


def alert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PROJECTION.format(text="string", flows="{flows}"), flows=flow_view(spark, sf_dir))


def odd_alert_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"{PROJECTION.format(text='string', flows='{flows}')} where {ODD}", flows=flow_view(spark, sf_dir))


def with_severity_rank(alerts: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return alerts.withColumn("severity_rank", rank)
