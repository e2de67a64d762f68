"""Queries on scans, aggregations, hunting, rules and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions import domains, net
from flowquarry.operators import analytics, hunt, sigma
from flowquarry.plans.registry import query
from flowquarry.sources.flows import flow_view

COLUMNS = "flow_id, t_us, src_ip, dst_ip, dst_port, protocol, bytes, packets"


@query(f"select {COLUMNS} from flows where dst_port = 443 and bytes >= 20000 order by t_us, flow_id limit 100")
def f1_columnar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.query(flow_view(spark, sf_dir), {"dst_port": 443, "min_bytes": 20000, "src_ip": None}, COLUMNS.split(", "))


@query(f"select {COLUMNS} from flows where tenant_id = 'default' and (src_port = 443 or dst_port = 443) order by t_us desc, flow_id desc limit 50")
def f3_flow_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.search(flow_view(spark, sf_dir), tenant="default", port=443).select(*COLUMNS.split(", "))


@query("select src_ip as ip, cast(sum(bytes) as bigint) as total, count(*) as flows from flows group by 1 order by 2 desc, 1 limit 10")
def a1_top_talkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_talkers(flow_view(spark, sf_dir))


@query(
    "select case protocol when 6 then 'TCP' when 17 then 'UDP' when 1 then 'ICMP' else concat('OTHER_', protocol) end as protocol_name, "
    "count(*) as flows, cast(sum(bytes) as bigint) as bytes, cast(sum(packets) as bigint) as packets from flows group by 1"
)
def a2_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.protocols(flow_view(spark, sf_dir))


@query("select (t_us // 10000000) * 10 as bucket, count(*) as flows, cast(sum(bytes) as bigint) as bytes, cast(sum(packets) as bigint) as packets from flows group by 1")
def a3_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.timeline(flow_view(spark, sf_dir), 10)


@query(
    ", ends as (select src_ip as ip, bytes as sent, 0 as received, packets from flows union all select dst_ip, 0, bytes, packets from flows) "
    "select ip, cast(sum(sent) as bigint) as sent, cast(sum(received) as bigint) as received, cast(sum(packets) as bigint) as packets, count(*) as flows, "
    "round((sum(sent) + sum(received)) / 1048576.0, 2) as total_mb from ends group by 1 order by sum(sent) + sum(received) desc, ip limit 10"
)
def a4_talkers_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.talkers_both_ways(flow_view(spark, sf_dir))


@query(
    "select case protocol when 6 then 'TCP' when 17 then 'UDP' else 'ICMP' end as protocol_name, count(*) as flows, "
    "round(count(*) * 100.0 / (select count(*) from flows), 1) as pct from flows group by 1"
)
def a4b_protocol_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.protocol_share(flow_view(spark, sf_dir)).withColumn("pct", F.col("pct").cast("double"))


@query(
    "select epoch_us(date_trunc('minute', ts)) as minute_us, tenant_id, protocol, dst_port, cast(sum(bytes) as bigint) as bytes, "
    "cast(sum(packets) as bigint) as packets, count(*) as flows from flows group by 1, 2, 3, 4"
)
def a8_minute_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = analytics.minute_rollup(flow_view(spark, sf_dir), "tenant_id", "protocol", "dst_port")
    return rolled.withColumn("minute_us", F.unix_micros("minute")).drop("minute")


@query(
    "select epoch_us(date_trunc('minute', ts)) as minute_us, tenant_id, src_ip, dst_ip, protocol, cast(sum(bytes) as bigint) as bytes, "
    "cast(sum(packets) as bigint) as packets, count(*) as flows from flows group by 1, 2, 3, 4, 5"
)
def a8_talker_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = analytics.minute_rollup(flow_view(spark, sf_dir), "tenant_id", "src_ip", "dst_ip", "protocol")
    return rolled.withColumn("minute_us", F.unix_micros("minute")).drop("minute")


@query("select t_us // 1000000 as second, round(sum(bytes) * 8 / 1e6, 4) as mbps, cast(sum(packets) as bigint) as pps, count(*) as fps from flows group by 1")
def a16_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pulse(flow_view(spark, sf_dir))


@query(
    ", o as (select *, case when t_us - lag(t_us) over w < 15000000 then 0 else 1 end as fresh from flows window w as "
    "(partition by src_ip, dst_ip, src_port, dst_port, protocol order by t_us, flow_id)), "
    "s as (select *, sum(fresh) over (partition by src_ip, dst_ip, src_port, dst_port, protocol order by t_us, flow_id) as session from o) "
    "select src_ip, dst_ip, src_port, dst_port, protocol, count(*) as packets, cast(sum(bytes) as bigint) as bytes, bit_or(tcp_flags) as tcp_flags, "
    "min(t_us) as first_us, max(t_us) as last_us from s group by src_ip, dst_ip, src_port, dst_port, protocol, session"
)
def s13_packet_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.packet_flows(flow_view(spark, sf_dir))


_TUPLE = "src_ip, dst_ip, src_port, dst_port, protocol"


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow view with one client port, so that tuples are used again after their flows have ended."""
    return flow_view(spark, sf_dir).withColumn("src_port", F.lit(40000))


@query(
    ", o as (select * replace (40000 as src_port), tcp_flags & 5 <> 0 as closing from flows), "
    f"a as (select *, case when t_us - lag(t_us) over (partition by {_TUPLE} order by t_us, flow_id) < 15000000 then 0 else 1 end as fresh from o), "
    f"s as (select *, sum(fresh) over (partition by {_TUPLE} order by t_us, flow_id) as segment from a), "
    f"l as (select {_TUPLE}, list(struct_pack(t := t_us, b := bytes, f := tcp_flags, c := closing) order by t_us, flow_id) as p from s group by {_TUPLE}, segment), "
    # one list of open counts per segment: how many packets the flow has before each packet, 0 after an end
    "n as (select *, list_reduce(list_transform(p, lambda x: [cast(x.c as int)]), lambda acc, x: list_concat(acc, [case when x[1] = 1 and acc[len(acc)] > 0 then 0 else acc[len(acc)] + 1 end]), [0]) as k from l), "
    f"u as (select {_TUPLE}, p, k, unnest(range(1, len(p) + 1)) as i from n), "
    "v as (select *, k[i + 1] as now, list_max(list_filter(range(1, i + 1), lambda j: k[j] = 0)) as began from u), "
    "w as (select *, p[i].c and k[i] > 0 as ends, i - began + 1 as packets from v), "
    "x as (select *, unnest(list_filter([case when ends then 'END' when packets % 10 = 0 then 'COUNT' end, case when not ends and i = len(p) then 'IDLE' end], lambda r: r is not null)) as reason from w) "
    "select src_ip, dst_ip, src_port, dst_port, protocol, packets, cast(list_sum(list_transform(p[began:i], lambda y: y.b)) as bigint) as bytes, list_bit_or(list_transform(p[began:i], lambda y: y.f)) as tcp_flags, p[began].t as first_us, p[i].t as last_us, reason from x"
)
def s13_packet_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.packet_exports(_services(spark, sf_dir), every=10)


@query(
    "select t_us // 1000000 as bucket, src_ip, dst_ip, src_port, dst_port, protocol, count(*) as packets, cast(sum(bytes) as bigint) as bytes from flows group by all"
)
def s14_probe_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.probe_flows(flow_view(spark, sf_dir))


@query("select protocol, count(*) as flows, cast(sum(bytes) as bigint) as bytes from flows group by 1 order by 2 desc")
def a23_sql_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select protocol, count(*) as flows, sum(bytes) as bytes from {f} group by 1 order by 2 desc", f=flow_view(spark, sf_dir))


@query("select src_ip, dst_ip, cast(sum(bytes) as bigint) as bytes from flows group by 1, 2 order by 3 desc, 1, 2 limit 5")
def a23_sql_top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select src_ip, dst_ip, sum(bytes) as bytes from {f} group by 1, 2 order by 3 desc, 1, 2 limit 5", f=flow_view(spark, sf_dir))


def _hunt(name: str, text: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hunt.hunt(flow_view(spark, sf_dir), text).select(*COLUMNS.split(", "))

    run.__name__ = name
    query(f"select {COLUMNS} from flows where {where} order by t_us, flow_id limit 100")(run)


#: The same conditions as SQL, one for each ready-made hunt and one for the rest of the language.
_hunt("f10_hunt_01", hunt.PLAYBOOKS["HUNT-01"], "dst_port = 445 and protocol = 6 and bytes > 51200")
_hunt("f10_hunt_02", hunt.PLAYBOOKS["HUNT-02"], "dst_port in (8080, 8443, 50050, 4444) and packets < 50 and bytes < 20480")
_hunt("f10_hunt_03", hunt.PLAYBOOKS["HUNT-03"], "dst_port = 53 and bytes > 4096")
_hunt("f10_hunt_04", hunt.PLAYBOOKS["HUNT-04"], "protocol = 6 and packets < 4 and bytes < 300")
_hunt("f10_hunt_05", hunt.PLAYBOOKS["HUNT-05"], "dst_port in (443, 80) and bytes > 10485760")
_hunt(
    "f6_hunt_language",
    "NOT domain CONTAINS 'A1' AND (src_ip == 10.0.1.1 OR dpt IN [53, 22]) AND proto != udp AND bytes >= 1.5K",
    "not coalesce(contains(lower(domain), 'a1'), false) and (src_ip = '10.0.1.1' or dst_port in (53, 22)) and protocol <> 17 and bytes >= 1536",
)


@query("select count(*) as total_scanned, cast(count_if(dst_port = 53 and bytes > 4096) as bigint) as total_matched from flows")
def f9_hunt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunt.hunt_report(flow_view(spark, sf_dir), hunt.PLAYBOOKS["HUNT-03"])


@query(
    ", r as (select flow_id, '9a8b7c6d-1122-3344-5566-778899aabb01' as rule_id, 'HIGH' as severity from flows where dst_port in (8080, 8443, 50050, 4444) and protocol = 6 and dst_ip not like '10.%' "
    "union all select flow_id, '9a8b7c6d-1122-3344-5566-778899aabb03', 'HIGH' from flows where dst_port = 53 and bytes > 5000 "
    "union all select flow_id, 'own', 'CRITICAL' from flows where dst_port = 445 and packets > 7) select * from r"
)
def f11_sigma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sigma.Rule("own", "Large SMB", "critical", {"dst_port": 445, "packets": "> 7"})
    flows = sigma.with_context(flow_view(spark, sf_dir), F.lit(0.9))
    return sigma.evaluate(flows, (*sigma.SHIPPED, own)).select("flow_id", "rule_id", "severity")


@query(
    ", a as (select distinct src_ip as ip from flows union select distinct dst_ip from flows) "
    "select ip, cast(split_part(ip, '.', 1) as bigint) * 16777216 + cast(split_part(ip, '.', 2) as bigint) * 65536 + cast(split_part(ip, '.', 3) as bigint) * 256 + cast(split_part(ip, '.', 4) as bigint) as number, "
    "ip like '10.%' as internal, ip like '10.%' or ip like '198.51.100.%' as private, ip like '10.%' as private_prefix from a"
)
def f13_address_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flow_view(spark, sf_dir)
    ip = F.col("ip")
    return flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().select(
        "ip", net.ip_number(ip).alias("number"), net.is_internal(ip).alias("internal"), net.is_private(ip).alias("private"), net.has_private_prefix(ip).alias("private_prefix")
    )


_ENTROPY = (
    "coalesce(list_sum(list_transform(list_sort(list_transform(list_distinct(string_split({0}, '')), lambda c: "
    "len(list_filter(string_split({0}, ''), lambda x: x = c)) / cast(length({0}) as double))), lambda p: -p * log2(p))), 0)"
)


@query(f", d as (select distinct domain from flows where domain is not null) select domain, round({_ENTROPY.format('domain')}, 4) as entropy from d")
def x1_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = flow_view(spark, sf_dir).where("domain is not null").select("domain").distinct()
    return names.select("domain", F.round(domains.entropy(F.col("domain")), 4).alias("entropy"))


_PAIR = "case " + " ".join(f"when p = '{pair}' then {v}" for pair, v in domains.PAIRS.items()) + f" else {domains.UNSEEN} end"


@query(
    f", d as (select distinct domain, split_part(domain, '.', -2) as sld from flows where domain is not null), e as (select *, round({_ENTROPY.format('sld')}, 6) as entropy, "
    "list_filter(list_transform(range(1, length(sld)), lambda i: substr(sld, cast(i as int), 2)), lambda p: regexp_full_match(p, '[a-z]{2}')) as pairs, "
    "(length(sld) - length(regexp_replace(sld, '[aeiou]', '', 'g'))) / cast(length(sld) as double) as vowels, "
    "(length(sld) - length(regexp_replace(sld, '[0-9]', '', 'g'))) / cast(length(sld) as double) as digits, "
    "coalesce(list_max(list_transform(regexp_extract_all(sld, '[b-df-hj-np-tv-z]+'), lambda r: length(r))), 0) as run from d), "
    f"a as (select *, case when len(pairs) = 0 then 0 else round(least(1, greatest(0, (-(list_sum(list_sort(list_transform(pairs, lambda p: {_PAIR}))) / len(pairs)) - 2.5) / 3.5)), 4) end as anomaly from e), "
    "s as (select *, anomaly * 0.35 + case when entropy >= 3.6 then 0.25 when entropy >= 3.2 then 0.15 else 0 end + case when vowels < 0.15 or vowels > 0.65 then 0.2 when vowels < 0.22 then 0.1 else 0 end "
    "+ case when run >= 5 then 0.15 when run >= 4 then 0.08 else 0 end + case when length(sld) >= 16 and (digits > 0.15 or anomaly > 0.6) then 0.15 when length(sld) >= 20 then 0.1 else 0 end as points from a) "
    "select domain, sld, round(anomaly, 4) as anomaly, run, round(least(1, points), 3) as score from s where length(sld) > 3"
)
def x9_dga_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = flow_view(spark, sf_dir).where("domain is not null").select("domain").distinct()
    found = names.select("domain", domains.dga_score(F.col("domain")).alias("d"))
    return found.select("domain", "d.sld", "d.anomaly", "d.run", F.round("d.score", 3).alias("score")).where(F.char_length("sld") > 3)


@query(" select flow_id, cast(cast(concat('0x', substr(md5(concat(least(src_ip, dst_ip), '|', greatest(src_ip, dst_ip))), 1, 8)) as bigint) % 16 as int) as worker from flows")
def x18_symmetric_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_view(spark, sf_dir).select("flow_id", net.symmetric_partition(F.col("src_ip"), F.col("dst_ip"), 16).alias("worker"))
