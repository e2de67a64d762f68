"""Queries on alert listings, postures, exports, responses, evaluation and anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import analytics, dims, evaluate, ml, report, response
from flowquarry.plans.registry import query
from flowquarry.sources.alerts import ALERTS_SQL, ODD_ALERTS_SQL, alert_view, odd_alert_view
from flowquarry.sources.flows import flow_view


def _values(rows: tuple, names: str) -> str:
    text = ", ".join("(" + ", ".join("null" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(values {text}) as d({names})"


_MITRE = f", mitre as (select * from {_values(dims.MITRE, 'category, tactic, technique_id, technique_name, subtechnique_id')})"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_view(spark, sf_dir)


def _by_hour(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hour", F.floor(F.col("t_us") / 3_600_000_000))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_techniques(alert_view(spark, sf_dir), dims.mitre(spark))


@query(
    ALERTS_SQL + ", m as (select * from alerts where severity = 'HIGH' and status = 'NEW') select alert_id, t_us, category, src_ip, (select count(*) from m) as total from m order by t_us desc, alert_id desc limit 10 offset 5"
)
def f4_alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = analytics.list_alerts(_alerts(spark, sf_dir), severity="HIGH", status="NEW", offset=5, limit=10)
    return page.select("alert_id", "t_us", "category", "src_ip", "total")


@query(ALERTS_SQL + " select severity, count(alert_id) as alerts from (values ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) s(severity) left join alerts using (severity) group by 1")
def a11_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(_alerts(spark, sf_dir))


@query(ALERTS_SQL + _MITRE + " select m.category, count(alert_id) as alerts from mitre m left join alerts a on a.category = m.category group by 1")
def a11_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.category_counts(_alerts(spark, sf_dir), dims.mitre(spark))


@query(
    ALERTS_SQL + _MITRE + ", s as (select category, count(*) as alerts, max(case severity when 'CRITICAL' then 3 when 'HIGH' then 2 else 1 end) as heat, array_to_string(list_sort(list(distinct src_ip))[1:10], ',') as sources, "
    "array_to_string(list_sort(list(distinct dst_ip))[1:10], ',') as targets, max(t_us) as last_us from alerts group by 1) "
    "select m.category, tactic, technique_id, coalesce(alerts, 0) as alerts, coalesce(heat, 0) as heat, coalesce(sources, '') as sources, coalesce(targets, '') as targets, last_us from mitre m left join s on s.category = m.category"
)
def a12_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.heat_map(_alerts(spark, sf_dir), dims.mitre(spark))


@query(
    ALERTS_SQL + ", n as (select cast(count_if(severity = 'CRITICAL') as bigint) as critical, cast(count_if(severity = 'HIGH') as bigint) as high from alerts where status <> 'RESOLVED'), "
    "p as (select *, greatest(0, 100 - 15 * critical - 5 * high) as score from n) select critical, high, score, case when score >= 90 then 'EXCELLENT' when score >= 70 then 'DEGRADED' else 'CRITICAL' end as level, "
    "case when critical > 0 then 'AT_RISK' else 'COMPLIANT' end as pci, case when high > 2 then 'NEEDS_REVIEW' else 'COMPLIANT' end as iso from p"
)
def a13_posture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.posture(_alerts(spark, sf_dir))


@query(
    ALERTS_SQL + ", o as (select least(100, coalesce(sum(case severity when 'LOW' then 1 when 'MEDIUM' then 4 when 'HIGH' then 12 else 25 end), 0)) as risk, count_if(severity = 'CRITICAL') as critical, count(*) as open_alerts from alerts where status in ('NEW', 'INVESTIGATING')) "
    "select cast(risk as bigint) as risk, cast(100 - risk as bigint) as posture, case when risk >= 60 or critical > 0 then 'CRITICAL' when risk >= 25 then 'HIGH' when risk >= 10 then 'MEDIUM' else 'LOW' end as label, cast(critical as bigint) as critical, open_alerts, "
    "(select cast(sum(bytes) as bigint) from flows) as bytes, (select cast(sum(packets) as bigint) from flows) as packets, (select count(*) from flows) as flows from o"
)
def a15_executive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.executive(_alerts(spark, sf_dir), flow_view(spark, sf_dir))


_HOUR = "t_us // 3600000000"


@query(
    ODD_ALERTS_SQL + f", n as (select tenant_id, {_HOUR} as hour, cast(count_if(severity = 'CRITICAL' and status <> 'RESOLVED') as bigint) as critical, cast(count_if(severity = 'HIGH' and status <> 'RESOLVED') as bigint) as high from alerts group by 1, 2), "
    "p as (select *, greatest(0, 100 - 15 * critical - 5 * high) as score from n) select tenant_id, hour, critical, high, score, case when score >= 90 then 'EXCELLENT' when score >= 70 then 'DEGRADED' else 'CRITICAL' end as level, "
    "case when critical > 0 then 'AT_RISK' else 'COMPLIANT' end as pci, case when high > 2 then 'NEEDS_REVIEW' else 'COMPLIANT' end as iso from p"
)
def a13_posture_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.posture(_by_hour(odd_alert_view(spark, sf_dir)), "tenant_id", "hour")


@query(
    ODD_ALERTS_SQL + f", a as (select tenant_id, {_HOUR} as hour, least(100, coalesce(sum(case severity when 'LOW' then 1 when 'MEDIUM' then 4 when 'HIGH' then 12 else 25 end), 0)) as risk, count_if(severity = 'CRITICAL') as critical, count(*) as open_alerts "
    f"from alerts where status in ('NEW', 'INVESTIGATING') group by 1, 2), f as (select tenant_id, {_HOUR} as hour, cast(sum(bytes) as bigint) as bytes, cast(sum(packets) as bigint) as packets, count(*) as flows from flows group by 1, 2), "
    "o as (select tenant_id, hour, coalesce(risk, 0) as risk, coalesce(critical, 0) as critical, coalesce(open_alerts, 0) as open_alerts, bytes, packets, flows from f left join a using (tenant_id, hour)) "
    "select tenant_id, hour, cast(risk as bigint) as risk, cast(100 - risk as bigint) as posture, case when risk >= 60 or critical > 0 then 'CRITICAL' when risk >= 25 then 'HIGH' when risk >= 10 then 'MEDIUM' else 'LOW' end as label, "
    "cast(critical as bigint) as critical, cast(open_alerts as bigint) as open_alerts, bytes, packets, flows from o"
)
def a15_executive_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.executive(_by_hour(odd_alert_view(spark, sf_dir)), _by_hour(flow_view(spark, sf_dir)), "tenant_id", "hour")


@query(ALERTS_SQL + _MITRE + " select a.alert_id, tactic, technique_id, subtechnique_id from alerts a left join mitre m on m.category = a.category")
def j8_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).select("alert_id", "tactic", "technique_id", "subtechnique_id")


_CONTROLS = _values(tuple((c, s, r) for c, needs in dims.CONTROLS.items() for s, r in zip(dims.STANDARDS, needs, strict=True)), "category, standard, requirement_id")


@query(ALERTS_SQL + f", c as (select category, array_to_string(list_sort(list(concat(standard, ': ', requirement_id))), '; ') as requirements from {_CONTROLS} group by 1) select alert_id, requirements from alerts left join c using (category)")
def j9_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_controls(_alerts(spark, sf_dir), dims.controls(spark)).select("alert_id", "requirements")


@query(ALERTS_SQL + _MITRE + " select technique_id, max(case severity when 'LOW' then 1 when 'MEDIUM' then 3 when 'HIGH' then 7 else 10 end) as score, count(*) as alerts from alerts a join mitre m on m.category = a.category group by 1")
def k8_navigator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.navigator(_alerts(spark, sf_dir), dims.mitre(spark))


_CEF = (
    "concat('CEF:0|flowquarry|flowquarry|1.0.0|', a.category, '|', title, '|', case severity when 'LOW' then 3 when 'MEDIUM' then 5 when 'HIGH' then 8 else 10 end, '|src=', src_ip, ' dst=', dst_ip, ' dpt=', dst_port, ' proto=', "
    "case protocol when 6 then 'TCP' else 'UDP' end, ' msg=a\\|b\\=c cs1=', status, ' cs1Label=IncidentStatus cfp1=', confidence, ' cfp1Label=ConfidenceScore cs2=', technique_id, ' cs2Label=MitreTechniqueId cs3=', tactic, ' cs3Label=MitreTactic')"
)


@query(ALERTS_SQL + _MITRE + f" select alert_id, {_CEF} as cef from alerts a join mitre m on m.category = a.category")
def k5_cef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cef(_known(spark, sf_dir))


@query(
    ALERTS_SQL + _MITRE + f" select alert_id, concat('<', case severity when 'CRITICAL' then 34 when 'HIGH' then 35 else 36 end, '>1 ', strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%fZ'), ' sensor engine - ID', substr(alert_id, 1, 8), "
    f"' [alert@5424 tenant=\"', tenant_id, '\"] ', {_CEF}) as line from alerts a join mitre m on m.category = a.category"
)
def k6_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.syslog(_known(spark, sf_dir))


@query()
def k7_ocsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ocsf(_known(spark, sf_dir))


@query()
def k8_navigator_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.navigator_layer(report.navigator(_alerts(spark, sf_dir), dims.mitre(spark)), "detections")


_TARGET = "case when category in ('MALICIOUS_C2', 'EXFILTRATION', 'C2_BEACONING') then dst_ip else src_ip end"


@query(
    ALERTS_SQL + f", t as (select alert_id, {_TARGET} as target_ip, case when category in ('MALICIOUS_C2', 'EXFILTRATION', 'C2_BEACONING') then 'LOW' when category in ('ATTACK_CAMPAIGN', 'LATERAL_MOVEMENT') then 'HIGH' when {_TARGET} like '10.%' or {_TARGET} like '192.168.%' then 'MEDIUM' else 'LOW' end as impact from alerts), "
    "p as (select * from (values "
    "('iptables', 'iptables -I INPUT 1 -s @ -j DROP && iptables -I FORWARD 1 -s @ -j DROP', 'iptables -D INPUT -s @ -j DROP && iptables -D FORWARD -s @ -j DROP'), "
    "('nftables', 'nft add element inet filter blackhole { @ }', 'nft delete element inet filter blackhole { @ }'), "
    "('cisco', concat('ip access-list extended ISOLATION', chr(10), ' 1 deny ip host @ any log'), concat('ip access-list extended ISOLATION', chr(10), ' no 1 deny ip host @ any log')), "
    """('aws_nacl', '{"RuleAction":"deny","RuleNumber":50,"CidrBlock":"@/32","Egress":false}', '{"RuleNumber":50,"Egress":false,"Delete":true}'), """
    "('exabgp', 'announce flow route { match { source @/32; } then { discard; } }', 'withdraw flow route { match { source @/32; } }')) v(platform, b, r)) "
    "select alert_id, target_ip, impact, platform, replace(b, '@', target_ip) as block, replace(r, '@', target_ip) as rollback from t, p"
)
def r1_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.playbooks(_alerts(spark, sf_dir))


@query(
    ALERTS_SQL + f" select alert_id, {_TARGET} as target_ip, severity, category, confidence from alerts where (severity = 'CRITICAL' and confidence >= 0.9) or (severity = 'HIGH' and confidence >= 0.95 and category in ('MALICIOUS_C2', 'LATERAL_MOVEMENT', 'EXFILTRATION'))"
)
def r2_containments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.containments(_alerts(spark, sf_dir))


@query(ALERTS_SQL + ", s as (select * from (values ('soc', 3), ('all', 1)) v(subscriber, least_rank)) select alert_id, subscriber from alerts join s on case severity when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 else 4 end >= least_rank")
def r3_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.deliveries(_alerts(spark, sf_dir), spark.createDataFrame([("soc", "HIGH"), ("all", "LOW")], "subscriber string, least string"))


#: The secret of the test deliveries, and as SQL the keys that HMAC pads it to.
_SECRET = b"flowquarry-test-secret"
_INNER, _OUTER = ("unhex('" + bytes(b ^ pad for b in _SECRET.ljust(64, b"\0")).hex() + "')" for pad in (0x36, 0x5C))


@query(
    ODD_ALERTS_SQL + ", b as (select alert_id, concat('{\"alert_id\":\"', alert_id, '\",\"category\":\"', category, '\",\"severity\":\"', severity, '\",\"src_ip\":\"', src_ip, '\",\"dst_ip\":\"', dst_ip, '\",\"dst_port\":', dst_port, ',\"confidence\":', confidence, '}') as body from alerts) "
    f"select alert_id, 'security_alert' as event, body, concat('sha256=', sha256({_OUTER} || unhex(sha256({_INNER} || encode(body))))) as signature from b"
)
def k12_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.signed_deliveries(odd_alert_view(spark, sf_dir), _SECRET)


_AT = "category in ('MALICIOUS_C2', 'EXFILTRATION', 'C2_BEACONING', 'SYN_FLOOD')"


@query(
    ALERTS_SQL + f", m as (select alert_id, case when category = 'SYN_FLOOD' then 'RATE_LIMIT' else 'DROP' end as action, concat_ws('; ', case when not ({_AT}) then 'source ' || src_ip || '/32' end, case when {_AT} then 'destination ' || dst_ip || '/32' end, "
    "case protocol when 6 then 'protocol tcp' when 17 then 'protocol udp' end, case when category in ('SYN_FLOOD', 'DNS_TUNNEL') then 'port =' || cast(dst_port as varchar) end) as match from alerts) "
    "select alert_id, action, match, concat('route alert-', alert_id, ' { match { ', match, '; } then { ', case action when 'DROP' then 'discard' else 'rate-limit 1000000' end, '; } }') as junos from m"
)
def r4_flowspec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.flowspec(_alerts(spark, sf_dir))


@query(
    ODD_ALERTS_SQL + ", x as (select f.src_ip in ('10.0.9.9', '10.0.7.7', '10.0.6.6', '10.0.4.4') or f.src_ip like '10.0.5.%' as bad, a.alert_id is not null as found from flows f left join alerts a on a.alert_id = cast(f.flow_id as varchar)), "
    "n as (select count_if(bad and found) as tp, count_if(not bad and found) as fp, count_if(bad and not found) as fn, count_if(not bad and not found) as tn from x), r as (select *, tp / (tp + fp) as p, tp / (tp + fn) as r from n) "
    "select cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn, round(p, 4) as precision, round(r, 4) as recall, round(2 * p * r / (p + r), 4) as f1, round(fp / (fp + tn), 4) as fpr from r"
)
def a17_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = odd_alert_view(spark, sf_dir).select(F.col("alert_id").cast("long").alias("flow_id"), F.lit(True).alias("hit"))
    rows = flow_view(spark, sf_dir).join(alerts, "flow_id", "left")
    attacks = F.col("src_ip").isin("10.0.9.9", "10.0.7.7", "10.0.6.6", "10.0.4.4") | F.col("src_ip").startswith("10.0.5.")
    return evaluate.confusion(rows.select(attacks.alias("is_malicious"), F.coalesce("hit", F.lit(False)).alias("alerted")))


_VECTORS = (("2", "10.9.9.9", "10.8.8.8", "HIGH", 1700000000000000), ("x1", "10.0.1.1", "0.0.0.0", "CRITICAL", 1700000000000000), ("x2", "9.9.9.9", "10.1.0.7", "LOW", 1700000000000000), ("x3", "9.9.9.9", "9.9.9.8", "LOW", 1700000000000000))
_VNAMES = "vector_id, attacker_ip, target_ip, expected_severity, started_us"
_FIRST = (
    f", v as (select * from {_values(_VECTORS, _VNAMES)}), m as (select v.*, alert_id, t_us, severity, row_number() over (partition by v.vector_id order by t_us, alert_id) as nth from v left join alerts a on a.vector_id = v.vector_id or a.src_ip = attacker_ip or a.dst_ip = target_ip)"
)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.createDataFrame(_VECTORS, "vector_id string, attacker_ip string, target_ip string, expected_severity string, started_us long")
    return evaluate.first_matches(vectors, _alerts(spark, sf_dir))


@query(ALERTS_SQL + _FIRST + " select vector_id, alert_id, t_us, severity from m where nth = 1")
def j12_first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("vector_id", "alert_id", "t_us", "severity")


@query(
    ALERTS_SQL + _FIRST + ", d as (select *, (t_us - started_us) / 1000.0 as delay from m where nth = 1) select count(*) as vectors, round(count(alert_id) / count(*), 4) as recall, round(count_if(severity = expected_severity) / count(*), 4) as severity_accuracy, "
    "round(avg(delay), 3) as mttd_mean, round(min(delay), 3) as mttd_min, round(max(delay), 3) as mttd_max from d"
)
def a18_campaign_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.campaign_metrics(_matched(spark, sf_dir))


@query(
    ALERTS_SQL + ", s as (select src_ip, count(*) as n, sum(bytes) as b from flows group by 1), d as (select dst_ip, count(*) as n, sum(bytes) as b from flows group by 1), "
    "p as (select src_ip, dst_ip, count(*) as n, sum(bytes) as b from flows group by 1, 2) "
    "select alert_id, coalesce(s.n, 0) + coalesce(d.n, 0) - coalesce(p.n, 0) as flows, cast(coalesce(s.b, 0) + coalesce(d.b, 0) - coalesce(p.b, 0) as bigint) as bytes "
    "from alerts a left join s on s.src_ip = a.src_ip left join d on d.dst_ip = a.dst_ip left join p on p.src_ip = a.src_ip and p.dst_ip = a.dst_ip"
)
def j11_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many flows stand behind each alert, and their bytes."""
    return evaluate.evidence_counts(_alerts(spark, sf_dir), flow_view(spark, sf_dir))


@query("select round(avg(bytes), 6) as mean_bytes, round(stddev_pop(bytes), 4) as sd_bytes, max(bytes) as max_bytes, round(avg(packets), 6) as mean_packets from flows")
def a21_baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ml.baseline_stats(ml.features(flow_view(spark, sf_dir)))
    return stats.select(F.round("mean_bytes", 6).alias("mean_bytes"), F.round("sd_bytes", 4).alias("sd_bytes"), "max_bytes", F.round("mean_packets", 6).alias("mean_packets"))


@query(", s as (select avg(bytes) as mb, stddev_pop(bytes) as sb, avg(packets) as mp, stddev_pop(packets) as sp from flows) select flow_id from flows, s where (bytes - mb) / greatest(sb, 1) > 5 or ((packets - mp) / greatest(sp, 1) > 4 and tcp_flags = 2)")
def m3_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.features(flow_view(spark, sf_dir))
    return ml.deviations(rows, ml.baseline_stats(rows)).select("flow_id")


_Z = ", ".join(
    f"{{{{'z': abs(({c} - avg({c}) over ()) / greatest(case when stddev_pop({c}) over () = 0 then 1 else stddev_pop({c}) over () end, 0.001)), 'name': '{c}'}}}}".replace("{{", "{").replace("}}", "}") for c in ml.FEATURES
)


@query(
    f", x as (select *, bytes / greatest(packets, 1) as bytes_per_packet from flows), p as (select flow_id, [{_Z}] as parts from x), "
    "t as (select flow_id, list_max(parts) as top, list_sum(list_transform(parts, lambda q: q.z)) as total from p) "
    "select flow_id, top.name as primary, case when total > 0 then round(top.z / total * 100, 1) else 0 end as share from t"
)
def m4_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.features(flow_view(spark, sf_dir))
    return ml.explain(rows, ml.baseline_stats(rows))


@query()
def m2_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.features(flow_view(spark, sf_dir))
    forest = ml.fit_forest(rows)
    scored = rows.select("flow_id", ml.forest_score(F.col("features"), forest).alias("score"))
    return scored.withColumn("anomalous", F.col("score") > forest.cut)


@query(
    ", g as (select src_ip as key, list({'n': 1::bigint, 'mean': bytes::double, 'var': 1::double} order by t_us, flow_id) as xs from flows group by 1), "
    "f as (select key, list_reduce(xs, lambda a, x: {'n': a.n + 1, 'mean': a.mean + 0.01 * (x.mean - a.mean), 'var': 0.99 * (a.var + 0.01 * (x.mean - a.mean) * (x.mean - a.mean))}) as s from g) "
    "select key, s.n as n, round(s.mean, 3) as mean, round(greatest(0.001, sqrt(s.var)), 3) as std from f"
)
def a20_online_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ml.online_means(flow_view(spark, sf_dir), "src_ip", "bytes")
    return out.select("key", "n", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))
