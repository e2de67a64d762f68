"""Queries on window detectors, conversations, indicators, hosts, campaigns and the host graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import biflow, correlate, detect, dims, engine, graph, hosts, intel, sessions_l7
from flowquarry.plans.registry import query
from flowquarry.sources.alerts import ALERTS_SQL, ODD_ALERTS_SQL, alert_view, odd_alert_view
from flowquarry.sources.cut import stored
from flowquarry.sources.flows import flow_view

FIRED = ("flow_id", "key", "severity", "confidence", "evidence")
END_US = 1_700_200_000_000_000
INTERNAL = "({0} like '10.%')"


def _over(keys: str, seconds: int) -> str:
    return f"over (partition by {keys} order by t_us range between {seconds}000000 preceding and current row)"


def _rounded(confidence: str) -> str:
    return f"round({confidence} + 1e-9, 2)::double as confidence"


def _scan_sql(final: str) -> str:
    w = _over("src_ip", 10)
    sure = _rounded("least(0.99, 0.85 + least(0.09, n / 50.0 * 0.09) + least(0.04, (m - 1) * 0.01) + case when tcp_flags & 2 = 2 then 0.0 else 0.02 end)")
    return (
        f", p as (select *, len(list_distinct(list(dst_port) {w})) as n, len(list_distinct(list(dst_ip) {w})) as m from flows where protocol = 6 and packets <= 4 and (tcp_flags & 2 = 2 or tcp_flags in (0, 1) or tcp_flags & 41 = 41)), "
        f"f as (select flow_id, t_us, src_ip as key, case when n >= 30 then 'HIGH' else 'MEDIUM' end as severity, {sure}, cast(n as double) as evidence from p where n >= 15) " + final
    )


@query(_scan_sql("select flow_id, key, severity, confidence, evidence from f"))
def w2_port_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.port_scan(flow_view(spark, sf_dir)).select(*FIRED)


@query(
    _scan_sql(
        "select key, unnest(kept) as t_us from (select key, list_reduce(list(t_us order by t_us), lambda a, x: case when len(a) = 0 or x - a[len(a)] >= 30000000 then list_append(a, x) else a end, cast([] as bigint[])) as kept from f group by key)"
    )
)
def w2_port_scan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.with_cooldown(detect.port_scan(flow_view(spark, sf_dir))).select("key", "t_us")


@query(
    f", p as (select *, count(*) {_over('dst_ip, dst_port', 5)} as n, len(list_distinct(list(src_ip) {_over('dst_ip, dst_port', 5)})) as s from flows where protocol = 6 and tcp_flags & 2 = 2 and tcp_flags & 16 = 0 and packets <= 4) "
    "select flow_id, concat(dst_ip, '|', dst_port) as key, case when n >= 60 then 'CRITICAL' else 'HIGH' end as severity, "
    + _rounded("least(0.99, 0.88 + least(0.06, (n - 30) * 0.002) + least(0.05, s / cast(n as double) * 0.05))")
    + ", cast(n as double) as evidence from p where n >= 30"
)
def w3_syn_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.syn_flood(flow_view(spark, sf_dir)).select(*FIRED)


_RUNNING = (
    ", k as (select *, least(struct_pack(ip := src_ip, port := src_port), struct_pack(ip := dst_ip, port := dst_port)) as low, "
    "greatest(struct_pack(ip := src_ip, port := src_port), struct_pack(ip := dst_ip, port := dst_port)) as high, "
    "case when tcp_flags & 18 = 18 then struct_pack(ip := dst_ip, port := dst_port) when tcp_flags & 2 = 2 or src_port >= dst_port then struct_pack(ip := src_ip, port := src_port) else struct_pack(ip := dst_ip, port := dst_port) end as opener from flows), "
    "c as (select *, first(opener) over w as client from k window w as (partition by low, high, protocol order by t_us, flow_id rows between unbounded preceding and current row)), "
    "o as (select *, struct_pack(ip := src_ip, port := src_port) = client as outward from c), "
    "r as (select *, sum(case when outward then bytes else 0 end) over w as sent, sum(case when outward then 0 else bytes end) over w as received from o "
    "window w as (partition by low, high, protocol order by t_us, flow_id rows between unbounded preceding and current row))"
)
_RATIO = "case when {1} <= 0 then case when {0} > 0 then cast({0} as double) else 1 end else round({0} / cast({1} as double), 3) end"


@query(_RUNNING + f" select flow_id, cast(sent as bigint) as sent, cast(received as bigint) as received, {_RATIO.format('sent', 'received')} as ratio from r")
def j6_running_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biflow.running_ratio(flow_view(spark, sf_dir)).select("flow_id", "sent", "received", "ratio")


@query(
    _RUNNING + f", q as (select *, {_RATIO.format('sent', 'received')} as ratio, count(*) over w as n, avg(bytes) over w as m, stddev_samp(bytes) over w as s from r "
    "window w as (partition by src_ip order by t_us, flow_id rows between unbounded preceding and current row)), "
    f"e as (select *, sum(bytes) {_over('src_ip, dst_ip', 60)} as volume, n >= 10 and coalesce(case when s > 1e-4 then round((bytes - m) / s, 2) end, 0) >= 3.5 and bytes >= 1000000 as odd from q "
    f"where {INTERNAL.format('src_ip')} and not {INTERNAL.format('dst_ip')}) "
    ", v as (select *, greatest(bytes, volume) / 1048576.0 as mb from e) "
    "select flow_id, concat(src_ip, '|', dst_ip) as key, case when mb >= 50 then 'CRITICAL' else 'HIGH' end as severity, "
    + _rounded("least(0.99, 0.86 + case when mb >= 20 then least(0.08, (mb - 20) * 0.003) else 0 end + case when dst_port in (80, 443, 8080) then 0 else 0.04 end + case when received > 0 and ratio > 20 then 0.04 else 0 end + case when odd then 0.05 else 0 end)")
    + ", cast(volume as double) as evidence from v where (bytes >= 20000000 or volume >= 50000000 or odd) and not (received > 0 and ratio < 0.2)"
)
def w4_bandwidth_exfil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.bandwidth_exfil(flow_view(spark, sf_dir)).select(*FIRED)


@query(
    f", d as (select *, bytes / cast(packets as double) as mean, sum(packets) {_over('src_ip, dst_ip', 10)} as sp, sum(bytes) {_over('src_ip, dst_ip', 10)} as sb from flows "
    "where protocol = 17 and dst_port = 53 and not (dst_ip in ('8.8.8.8', '8.8.4.4', '1.1.1.1', '1.0.0.1', '9.9.9.9', '149.112.112.112', '192.168.1.1', '10.0.0.1') and packets > 0 and bytes / cast(packets as double) < 320)) "
    "select flow_id, concat(src_ip, '|', dst_ip) as key, 'HIGH' as severity, "
    + _rounded("least(0.98, 0.85 + greatest(0.0, least(0.08, (mean - 320) / 1000.0)) + greatest(0.0, least(0.05, (sp - 25) * 0.002)))")
    + ", cast(sb as double) as evidence from d where mean >= 320 or (sp >= 25 and sb / cast(sp as double) > 250)"
)
def w5_dns_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dns_volume(flow_view(spark, sf_dir)).select(*FIRED)


@query(
    f", b as (select *, list(t_us) {_over('src_ip, dst_ip, dst_port', 600)} as raw from flows where bytes <= 500000), s as (select *, list_sort(raw) as ts_list from b where len(raw) >= 5), "
    "g as (select *, list_filter(list_transform(range(2, len(ts_list) + 1), lambda i: (ts_list[i] - ts_list[i-1]) / 1e6), lambda x: x > 0.05) as gaps from s), "
    "m as (select *, list_sum(gaps) / len(gaps) as mean from g where len(gaps) >= 4), "
    "v as (select *, sqrt(list_sum(list_transform(gaps, lambda x: (x - mean) * (x - mean))) / (len(gaps) - 1)) / mean as cv from m where mean between 2 and 300) "
    "select flow_id, concat(src_ip, '|', dst_ip, '|', dst_port) as key, case when dst_ip not like '10.%' and dst_ip not like '198.51.100.%' and dst_port not in (80, 443) then 'CRITICAL' else 'HIGH' end as severity, "
    + _rounded("least(0.98, greatest(0.85, 1 - cv))")
    + ", round(mean + 1e-9, 6) as evidence from v where cv <= 0.35"
)
def w7_beaconing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.beaconing(flow_view(spark, sf_dir)).select(*FIRED)
    return found.withColumn("evidence", F.round(F.col("evidence") + 1e-9, 6))


@query(
    f", l as (select *, list_distinct(list(dst_ip) {_over('src_ip', 30)}) as hosts, list_distinct(list(dst_port) {_over('src_ip', 30)}) as ports from flows "
    f"where {INTERNAL.format('src_ip')} and {INTERNAL.format('dst_ip')} and src_ip <> dst_ip and dst_port in (22, 135, 139, 445, 3389, 5985, 5986)) "
    "select flow_id, src_ip as key, case when len(hosts) >= 6 or (list_contains(ports, 445) and list_contains(ports, 3389)) then 'CRITICAL' when len(hosts) >= 4 or list_contains(ports, 445) then 'HIGH' else 'MEDIUM' end as severity, "
    + _rounded("least(0.99, 0.88 + least(0.08, (len(hosts) - 3) * 0.02) + case when list_contains(ports, 445) then 0.03 else 0 end)")
    + ", cast(len(hosts) as double) as evidence from l where len(hosts) >= 3"
)
def w8_lateral_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.lateral_movement(flow_view(spark, sf_dir)).select(*FIRED)


@query(
    _RUNNING + f" select flow_id, concat_ws('|', src_ip, dst_ip, dst_port) as key, 'HIGH' as severity, 0.91::double as confidence, cast(bytes as double) as evidence from (select *, {_RATIO.format('sent', 'received')} as ratio from r) "
    "where protocol = 6 and (dst_port in (443, 8443, 9443) or src_port in (443, 8443, 9443)) and src_ip like '10.%' and dst_ip not like '10.%' and bytes >= 5000000 and bytes / packets >= 1150 and (received <= 0 or ratio >= 0.85)"
)
def w9_encrypted_exfil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.encrypted_exfil(flow_view(spark, sf_dir)).select(*FIRED)


@query(
    ", t as (select *, bytes / cast(packets as double) as mean from flows where protocol = 6 and (dst_port in (443, 8443, 9443) or src_port in (443, 8443, 9443)) and not (src_ip like '10.%' and dst_ip like '10.%')), "
    "n as (select *, sum(case when mean between 100 and 500 and packets between 4 and 60 then 1 else 0 end) over (partition by src_ip, dst_ip, dst_port order by t_us, flow_id rows between 19 preceding and current row) as n from t) "
    "select flow_id, concat_ws('|', src_ip, dst_ip, dst_port) as key, 'HIGH' as severity, 0.88::double as confidence, cast(n as double) as evidence from n "
    "where src_ip like '10.%' and dst_ip not like '10.%' and packets between 5 and 50 and mean between 120 and 480 and n >= 3"
)
def w10_encrypted_beacon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.encrypted_beacon(flow_view(spark, sf_dir)).select(*FIRED)


@query(
    ", b as (select flow_id, src_ip, bytes, count(*) over w as n, avg(bytes) over w as m, stddev_samp(bytes) over w as s from flows window w as (partition by src_ip order by t_us, flow_id rows between unbounded preceding and 1 preceding)) "
    "select flow_id, src_ip, n as n_before, round(coalesce(case when n >= 5 and s > 1e-4 then (bytes - m) / s end, 0), 2) + 0.0 as z, n >= 10 and coalesce(case when n >= 5 and s > 1e-4 then round((bytes - m) / s, 2) end, 0) >= 3.5 as unusual from b"
)
def w1_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.baseline(flow_view(spark, sf_dir)).select("flow_id", "src_ip", "n_before", (F.col("z") + 0.0).alias("z"), "unusual")


_REUSED = ", reused as (select * replace (case when src_port >= 9500 then 40000 + src_port % 4 else src_port end as src_port, case when dst_port >= 9500 then 40000 + dst_port % 4 else dst_port end as dst_port) from flows)"


def _reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow view as packets of clients that use few ports again and again."""
    once = lambda c: F.when(F.col(c) >= 9500, 40000 + F.col(c) % 4).otherwise(F.col(c)).cast("int")
    return flow_view(spark, sf_dir).withColumns({"src_port": once("src_port"), "dst_port": once("dst_port")})


@query(
    _REUSED + ", sized as (select * replace (bytes // packets as bytes) from reused)" + _RUNNING.split(", c as")[0].replace("from flows", "from sized") + ", c as (select *, row_number() over w as nth, first(opener) over w as client from k window w as (partition by low, high, protocol order by t_us, flow_id rows between unbounded preceding and current row)), "
    "g as (select low, high, protocol, any_value(client) as client, arg_min(flow_id, nth) as flow_id, first(ja4 order by nth) as ja4, list(case when struct_pack(ip := src_ip, port := src_port) = client then bytes else -bytes end order by nth) as lengths from c where nth <= 32 group by 1, 2, 3), "
    "s as (select *, case when client = low then high else low end as server, list_filter(lengths, lambda x: x > 0) as sent, list_transform(lengths, lambda x: cast(abs(x) as double)) as sizes from g), "
    "m as (select *, list_avg(sent) as mean, list_sum(sizes) as total from s where protocol = 6 and server.port in (443, 8443, 9443) and len(lengths) >= 4 and len(sent) >= 3 "
    f"and coalesce(split_part(ja4, '_', 1) not in {dims.BENIGN_JA4}, true)) "
    "select flow_id, concat(client.ip, '|', server.ip, '|', server.port) as key, round(list_sum(list_transform(sizes, lambda x: case when x > 0 then -x / total * log2(x / total) else 0 end)), 4) as evidence from m "
    "where mean <= 800 and list_avg(list_transform(sent, lambda x: (x - mean) * (x - mean))) < 150"
)
def x4_splt_beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = sessions_l7.packet_lengths(_reused(spark, sf_dir).withColumn("bytes", F.expr("bytes div packets")))
    return sessions_l7.splt_beacons(profiles).select("flow_id", "key", "evidence")


@query()
def w_all_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine over the flow view."""
    return engine.alerts(flow_view(spark, sf_dir))


@query(
    _RUNNING.split(", c as")[0] + ", s as (select low, high, protocol, arg_min(opener, struct_pack(t := t_us, f := flow_id)) as client, "
    "sum(case when struct_pack(ip := src_ip, port := src_port) = low then bytes else 0 end) as lb, sum(case when struct_pack(ip := src_ip, port := src_port) = low then 0 else bytes end) as hb, "
    "bit_or(tcp_flags) as flags, bool_or(tcp_flags & 18 = 18) as answered, count(*) as flows from k group by 1, 2, 3), "
    "d as (select *, case when client = low then lb else hb end as sent, case when client = low then hb else lb end as received from s) "
    "select client.ip as client_ip, client.port as client_port, protocol, cast(sent as bigint) as sent, cast(received as bigint) as received, flags, flows, "
    "case when protocol <> 6 or flows < 2 then null when flags & 4 > 0 then 'RESET' when received > 0 or answered then 'ESTABLISHED' else 'UNANSWERED' end as state, "
    f"{_RATIO.format('sent', 'received')} as ratio from d"
)
def a5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biflow.sessions(flow_view(spark, sf_dir)).select("client_ip", "client_port", "protocol", "sent", "received", "flags", "flows", "state", "ratio")


@query(
    _REUSED + _RUNNING.split(", c as")[0].replace("from flows", "from reused") + ", y as (select *, case when t_us - lag(t_us) over w <= 60000000 then 0 else 1 end as fresh from k window w as (partition by low, high, protocol order by t_us, flow_id)), "
    "z as (select *, sum(fresh) over (partition by low, high, protocol order by t_us, flow_id) as part from y), s as (select low, high, protocol, arg_min(opener, struct_pack(t := t_us, f := flow_id)) as client, "
    "sum(case when struct_pack(ip := src_ip, port := src_port) = low then bytes else 0 end) as lb, sum(case when struct_pack(ip := src_ip, port := src_port) = low then 0 else bytes end) as hb, "
    "bit_or(tcp_flags) as flags, bool_or(tcp_flags & 18 = 18) as answered, count(*) as flows, min(t_us) as first_us, max(t_us) as last_us from z group by low, high, protocol, part), "
    "d as (select *, case when client = low then lb else hb end as sent, case when client = low then hb else lb end as received from s) "
    "select client.ip as client_ip, client.port as client_port, protocol, cast(sent as bigint) as sent, cast(received as bigint) as received, flags, flows, first_us, last_us, "
    "case when protocol <> 6 or flows < 2 then null when flags & 4 > 0 then 'RESET' when received > 0 or answered then 'ESTABLISHED' else 'UNANSWERED' end as state, "
    f"{_RATIO.format('sent', 'received')} as ratio from d"
)
def st2_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = biflow.sessions(_reused(spark, sf_dir), idle_s=60)
    return rows.select("client_ip", "client_port", "protocol", "sent", "received", "flags", "flows", "first_us", "last_us", "state", "ratio")


@query(
    ", p as (select least(src_ip, dst_ip) as ip_a, greatest(src_ip, dst_ip) as ip_b, sum(case when src_ip <= dst_ip then bytes else 0 end) as x, sum(case when src_ip <= dst_ip then 0 else bytes end) as y from flows group by 1, 2) "
    f"select ip_a, ip_b, cast(x as bigint) as a_to_b, cast(y as bigint) as b_to_a, {_RATIO.format('x', 'y')} as ratio from p"
)
def a7_pair_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return biflow.pair_ratio(flow_view(spark, sf_dir))


_HIT_1 = "('198.51.100.77', '45.33.32.156')"


@query(
    f"select flow_id, case when dst_ip in {_HIT_1} then 'dst' else 'src' end as side, case when dst_ip = '198.51.100.77' or (dst_ip not in {_HIT_1} and src_ip = '198.51.100.77') then 'Cobalt Strike C2' else 'Mirai Botnet C2' end as ioc_family, "
    f"'CRITICAL' as ioc_severity from flows where dst_ip in {_HIT_1} or src_ip in {_HIT_1}"
)
def j1_exact_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intel.match_exact(flow_view(spark, sf_dir), dims.malicious_ips(spark))
    return found.select("flow_id", "side", "ioc_family", "ioc_severity")


_FAMILY = "case when {0} like '198.51.100.%' then 'doc net' when {0} like '10.1.%' then 'lab' when {0} like '10.0.%' then 'office' when {0} like '198.51.%' then 'wider' end"


@query(
    f", n as (select flow_id, {_FAMILY.format('dst_ip')} as d, {_FAMILY.format('src_ip')} as s from flows) "
    "select flow_id, case when d is not null then 'dst' else 'src' end as side, coalesce(d, s) as family from n where d is not null or s is not null"
)
def j2_network_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    nets = [("198.51.100.0/24", "doc net"), ("10.1.0.0/16", "lab"), ("10.0.0.0/15", "office"), ("198.51.0.0/16", "wider")]
    return intel.match_networks(flow_view(spark, sf_dir), nets).select("flow_id", "side", "family")


_LEVEL = f"case when {{0}} in {_HIT_1} then 'CRITICAL' when {{0}} like '8.8.%' then 'HIGH' end"
_SEED = "case {0} when '198.51.100.77' then 0.98 when '198.51.100.200' then 0.95 end"


@query(
    f", n as (select *, coalesce({_LEVEL.format('dst_ip')}, {_LEVEL.format('src_ip')}) as level, {_SEED.format('dst_ip')} as d, {_SEED.format('src_ip')} as s from flows) "
    "select flow_id, case when level is not null then 'indicator' else 'indicator_filter' end as detector, case when level is not null then level when d is not null then 'CRITICAL' else 'HIGH' end as severity, "
    "(case when level is not null then 0.98 else coalesce(d, s) end)::double as confidence from n where level is not null or d is not null or s is not null"
)
def j3_indicator_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact feed, then networks, and the second feed only where both miss."""
    found = intel.indicator_alerts(flow_view(spark, sf_dir), dims.malicious_ips(spark), [("8.8.0.0/16", "resolver")], dims.seed_iocs(spark))
    return found.select("flow_id", "detector", "severity", "confidence")


@query("select flow_id, case when ja4 = 't13d1516h2_8daaf6152771_e562703ab855' then 'Cobalt Strike C2' end as family, split_part(ja4, '_', 1) in ('t13d1516h2', 't13d1715h2') as common_client from flows where ja4 is not null")
def j7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel.match_fingerprints(flow_view(spark, sf_dir), dims.fingerprints(spark), dims.BENIGN_JA4).select("flow_id", "family", "common_client")


@query("select distinct key, key in (select src_ip from flows) as contained from (select src_ip as key from flows union all select dst_ip from flows) k")
def j4_bloom_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flow_view(spark, sf_dir)
    names = flows.select(F.col("src_ip").alias("key")).distinct()
    counters = intel.bloom_counters(names.withColumn("n", F.lit(1)), 10_000, 0.001)
    return intel.bloom_contains(counters, names.union(flows.select("dst_ip")).distinct(), 10_000, 0.001)


_ROLES = (
    ", e as (select dst_ip as ip, src_ip as client, dst_port as port, null as managed from flows union all select src_ip, null, null, case when dst_port in (445, 135, 5985, 22) and dst_ip like '10.%' then dst_ip end from flows), "
    "c as (select ip, count(distinct case when port = 53 then client end) as c53, count(distinct case when port = 445 then client end) as c445, count(distinct case when port = 88 then client end) as c88, count(distinct case when port = 389 then client end) as c389, "
    "count(distinct case when port = 80 then client end) + count(distinct case when port = 443 then client end) as web, count(distinct case when port = 3306 then client end) + count(distinct case when port = 5432 then client end) as db, count(distinct managed) as m "
    "from e where ip like '10.%' group by ip), roles as (select ip, case when c88 >= 3 or c389 >= 3 or (c445 >= 5 and (c88 > 0 or c389 > 0)) then 'INFRASTRUCTURE_DC' when c53 >= 4 then 'INFRASTRUCTURE_DNS' "
    "when m >= 5 and c445 < 2 then 'ADMIN_MANAGEMENT' when web >= 4 or db >= 3 then 'INTERNAL_SERVER' else 'WORKSTATION' end as role from c)"
)


@query(_ROLES + " select * from roles")
def e6_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.roles(flow_view(spark, sf_dir))


_WEIGHT = "case severity when 'LOW' then 5.0 when 'MEDIUM' then 15.0 when 'HIGH' then 35.0 else 60.0 end"


@query(
    ALERTS_SQL + f" select src_ip as ip, 'UNKNOWN' as role, round(least(100, sum(cast({_WEIGHT} as double) * pow(2.0, -(({END_US} - t_us) / 1e6) / 3600.0))), 2) as score, count(*) as alerts from alerts where t_us <= {END_US} group by 1"
)
def e2_threat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.threat_scores(alert_view(spark, sf_dir), END_US)


@query(
    ", l as (select src_ip as ip, concat('AA-BB-', src_port) as mac, concat('HOST', src_port) as hostname, t_us from flows where tcp_flags & 2 = 2) "
    "select ip, replace(lower(mac), '-', ':') as mac, lower(hostname) as hostname, t_us as from_us, lead(t_us) over (partition by ip order by t_us, mac) as until_us from l"
)
def e5_lease_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening flows as if each were a lease of its source's address to the device that its port names."""
    names = {"ip": F.col("src_ip"), "mac": F.concat(F.lit("AA-BB-"), F.col("src_port")), "hostname": F.concat(F.lit("HOST"), F.col("src_port"))}
    opened = flow_view(spark, sf_dir).where("tcp_flags & 2 = 2")
    return hosts.lease_intervals(opened.select(*[c.alias(n) for n, c in names.items()], "t_us"))


#: Times within the flow view at which hosts' scores are low, middling and at their bound.
SCORED_US = tuple(1_700_000_000_000_000 + h * 3_600_000_000 for h in (1, 29, 31, 36, 42))


@query(
    ODD_ALERTS_SQL + f", times as (select unnest({list(SCORED_US)}) as as_of_us) select src_ip as ip, as_of_us, 'UNKNOWN' as role, "
    f"round(least(100, sum(cast({_WEIGHT} as double) * pow(2.0, -((as_of_us - t_us) / 1e6) / 3600.0))), 2) as score, count(*) as alerts from alerts join times on t_us <= as_of_us group by 1, 2"
)
def e2_score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.threat_history(odd_alert_view(spark, sf_dir), list(SCORED_US))


@query(
    ", leases as (select concat('10.0.', k % 4, '.', k % 25) as ip, concat('aa-bb-', k) as mac, concat('HOST', k) as hostname, 1700100000000000 + k * 1000000 as lt from range(200) t(k)) "
    "select flow_id, src_ip as ip, t_us, replace(lower(mac), '-', ':') as mac, lower(hostname) as hostname from flows asof left join leases on src_ip = ip and t_us >= lt"
)
def j13_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = spark.range(200).selectExpr("concat('10.0.', id % 4, '.', id % 25) as ip", "concat('aa-bb-', id) as mac", "concat('HOST', id) as hostname", "1700100000000000 + id * 1000000 as t_us")
    return hosts.identities(flow_view(spark, sf_dir), leases)


_STAGE = "case " + " ".join(f"when category = '{c}' then '{s}'" for c, s in correlate.STAGES.items()) + " end"


@query(
    ALERTS_SQL + f", s as (select *, {_STAGE} as stage from alerts where category <> 'ATTACK_CAMPAIGN'), w as (select *, list_sort(list_distinct(list(stage) {_over('src_ip', 900)})) as stages, count(*) {_over('src_ip', 900)} as n_alerts from s), "
    "r as (select *, row_number() over (partition by src_ip, stages order by t_us, alert_id) as nth from w where len(stages) >= 2) "
    "select src_ip, t_us, alert_id, array_to_string(stages, ' -> ') as progression, n_alerts from r where nth = 1"
)
def w23_kill_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.kill_chain(alert_view(spark, sf_dir))


@query()
def c3_bayesian_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.cases(alert_view(spark, sf_dir))


@query()
def c5_case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.case_list(correlate.cases(alert_view(spark, sf_dir)), "escalated")


_EDGES = ", edges as (select src_ip, dst_ip, cast(sum(bytes) as bigint) as bytes, cast(sum(packets) as bigint) as packets, count(*) as flows, min(t_us) as first_us, max(t_us) as last_us, array_to_string(list_sort(list(distinct dst_port)), ',') as ports from flows group by 1, 2)"


@query(_EDGES + " select * from edges")
def a9_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(flow_view(spark, sf_dir)).withColumn("ports", F.array_join("dst_ports", ",")).drop("protocols", "dst_ports")


@query(_EDGES + ", d as (select src_ip as ip, 1 as o, 0 as i from edges union all select dst_ip, 0, 1 from edges) select ip, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from d group by 1")
def a10_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.edges(flow_view(spark, sf_dir)))


_HIT = (
    ", h as (select t_us, src_ip as ip, case severity when 'MEDIUM' then 40 when 'HIGH' then 75 else 100 end * confidence as score from alerts where severity <> 'LOW' union all "
    "select t_us, dst_ip, case severity when 'MEDIUM' then 40 when 'HIGH' then 75 else 100 end * confidence * 0.8 from alerts where severity <> 'LOW' and category = 'LATERAL_MOVEMENT'), "
    "hit as (select ip, min(t_us) as compromised_us, round(max(score), 2) as risk from h group by 1)"
)


@query(ALERTS_SQL + _HIT + " select * from hit")
def g2_compromised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.compromised(alert_view(spark, sf_dir))


@query(
    _EDGES + ", e as (select src_ip, dst_ip from edges union select dst_ip, src_ip from edges where dst_ip like '%7'), s as (select '10.0.1.1' as ip union all select '10.1.0.7'), "
    "r1 as (select s.ip as start_ip, dst_ip as ip, 1 as hops from s join e on e.src_ip = s.ip), r2 as (select start_ip, dst_ip as ip, 2 as hops from r1 join e on e.src_ip = r1.ip), "
    "r3 as (select start_ip, dst_ip as ip, 3 as hops from r2 join e on e.src_ip = r2.ip), a as (select * from r1 union all select * from r2 union all select * from r3) "
    "select start_ip, ip, min(hops) as hops from a where ip <> start_ip group by 1, 2"
)
def g3_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = graph.edges(flow_view(spark, sf_dir)).select("src_ip", "dst_ip")
    both = steps.union(steps.where("dst_ip like '%7'").select("dst_ip", "src_ip"))
    return graph.reach(both, spark.createDataFrame([("10.0.1.1",), ("10.1.0.7",)], "start_ip string"))


_WEIGHTS = "case role " + " ".join(f"when '{k}' then {v}" for k, v in graph.ROLE_RISK.items()) + " else 5.0 end"


@query(
    ALERTS_SQL + _HIT + _ROLES + ", st as (select distinct src_ip, dst_ip from flows), s0 as (select distinct src_ip as start_ip from flows), h1 as (select start_ip, dst_ip as ip from s0 join st on src_ip = start_ip), "
    "h2 as (select distinct start_ip, dst_ip as ip from h1 join st on src_ip = h1.ip), h3 as (select distinct start_ip, dst_ip as ip from h2 join st on src_ip = h2.ip), "
    "al as (select *, 1 as hops from h1 union all select *, 2 from h2 union all select *, 3 from h3), m as (select start_ip, ip, min(hops) as hops from al where ip <> start_ip group by 1, 2), "
    f"w as (select start_ip, count(*) as reachable, count_if(role in ('INFRASTRUCTURE_DC', 'INTERNAL_SERVER', 'ADMIN_MANAGEMENT')) as critical, sum({_WEIGHTS} / pow(hops, 0.75)) as weight from m left join roles using (ip) group by 1), "
    "x as (select s0.start_ip, reachable, critical, least(100.0, greatest(round(coalesce(weight, 0) / 120.0 * 100.0, 1), coalesce(risk * 0.5, 0))) as score from s0 left join w using (start_ip) left join hit on hit.ip = s0.start_ip) "
    "select start_ip, coalesce(reachable, 0) as reachable, cast(coalesce(critical, 0) as bigint) as critical, cast(score as double) as score, case when score >= 70 then 'CRITICAL' when score >= 45 then 'HIGH' when score >= 20 then 'MEDIUM' else 'LOW' end as level from x"
)
def g3_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows, alerts = flow_view(spark, sf_dir), alert_view(spark, sf_dir)
    steps = graph.edges(flows)
    return graph.blast_radius(steps, steps.select(F.col("src_ip").alias("start_ip")).distinct(), hosts.roles(flows), graph.compromised(alerts))


@query()
def g4_patient_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows, alerts = flow_view(spark, sf_dir), alert_view(spark, sf_dir)
    hit = stored(graph.compromised(alerts), "compromised")
    return graph.patient_zero(graph.marked_edges(graph.edges(flows), alerts), hit, hit.select(F.col("ip").alias("target_ip")))


@query(ALERTS_SQL + _HIT + _EDGES + " select src_ip, dst_ip, bytes, flows, a.ip is not null as src_hit, b.ip is not null as dst_hit from edges left join hit a on a.ip = src_ip left join hit b on b.ip = dst_ip where a.ip is not null or b.ip is not null")
def g5_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topology(graph.edges(flow_view(spark, sf_dir)), graph.compromised(alert_view(spark, sf_dir)), True)
