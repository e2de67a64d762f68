"""Queries on application messages, wire decoders, evidence and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions import wire
from flowquarry.operators import analytics, evidence, hosts, intel, response, sessions_l7
from flowquarry.plans.detection_queries import _over
from flowquarry.plans.registry import query
from flowquarry.sources import feeds, netflow
from flowquarry.sources.alerts import ALERTS_SQL, alert_view
from flowquarry.sources.flows import flow_view
from flowquarry.sources.messages_view import message_view, view_sql

FIRED = ("flow_id", "detector", "category", "severity", "confidence", "evidence")


def _listed(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _first(text: str, values: tuple[str, ...]) -> str:
    return f"list_filter({_listed(values)}, lambda pattern: contains({text}, pattern))[1]"


_BOT_SEVERITY = "case bot " + " ".join(f"when '{k}' then '{v}'" for k, v in sessions_l7.BOTS.items()) + " end"
_GUARDED = "regexp_replace({0}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?$)', '%25\\1', 'g')"
_DECODED = f"url_decode({_GUARDED})"
_WEB = (
    view_sql("requests")
    + ", a as (select *, lower(path) as p, coalesce(tenant, nullif(regexp_extract(lower(path), '/(?:tenants|orgs|workspaces)/([a-zA-Z0-9_\\-]+)', 1), '')) as seen, "
    + f"case when method in ('POST', 'PUT') and len(list_filter({_listed(sessions_l7.AUTH_PATHS)}, lambda x: lower(path) = x or starts_with(lower(path), x || '/'))) > 0 then 1 else 0 end as sign_in from requests), "
    + f"b as (select *, sum(sign_in) {_over('src_ip', 10)} as sign_ins, count(*) {_over('src_ip', 5)} as n, len(list_distinct(list(seen) {_over('src_ip', 30)})) as tenants, "
    + f"dst_ip in {tuple(sessions_l7.METADATA_IPS)} or contains(host, '{sessions_l7.METADATA_IPS[0]}') as metadata, {_first('lower(user_agent)', tuple(sessions_l7.BOTS))} as bot, "
    + f"lower(concat_ws(' ', {_DECODED.format(_DECODED.format('uri'))}, body)) as sent from a), "
    + f"c as (select *, {_BOT_SEVERITY} as bot_severity, {_first('sent', sessions_l7.SQLI)} as sqli, {_first('p', sessions_l7.SENSITIVE)} as odd from b), "
    + "d as (select *, case when metadata then 'ssrf_metadata' when sign_in = 1 and sign_ins >= 8 then 'credential_stuffing' when n >= 35 then 'api_flood' when seen is not null and tenants >= 3 then 'tenant_hopping' "
    + "when bot is not null and (bot_severity in ('CRITICAL', 'HIGH') or n > 3) then 'bot_agent' when sqli is not null then 'sql_injection' when odd is not null then 'path_fuzzing' end as rule from c) "
    + "select flow_id, concat('web:', rule) as detector, 'WEB_APP_THREAT' as category, case when rule in ('api_flood', 'path_fuzzing') then 'HIGH' when rule = 'bot_agent' then bot_severity else 'CRITICAL' end as severity, "
    + "case rule when 'ssrf_metadata' then 0.98 when 'credential_stuffing' then 0.94 when 'api_flood' then 0.91 when 'tenant_hopping' then 0.95 when 'bot_agent' then 0.88 when 'sql_injection' then 0.97 else 0.92 end::double as confidence, "
    + "n::double as evidence from d where rule is not null"
)


@query(_WEB)
def w15_web_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_l7.web_threats(message_view(spark, sf_dir, "requests")).select(*FIRED)


@query()
def w15_web_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of web rules with its cooldowns; the tests hold it against one record at a time."""
    return sessions_l7.web_alerts(message_view(spark, sf_dir, "requests")).select(*FIRED, "key", "t_us")


_INNER = (
    "select flow_id, t_us, src_ip, {metadata} as dst_ip, cast({port} as int) as dst_port, protocol, bytes from {flows}".replace("{metadata}", "case when flow_id % 50 = 0 then '169.254.169.254' else dst_ip end").replace(
        "{port}", "case flow_id % 6 when 0 then 5432 when 1 then 6379 else dst_port end"
    )
)


@query(
    f", i as ({_INNER.format(flows='flows')}), f as (select *, dst_ip in {sessions_l7.METADATA_IPS} as metadata from i where dst_ip in {sessions_l7.METADATA_IPS} or (dst_port in {sessions_l7.DATABASE_PORTS} and not starts_with(src_ip, '127.') and not starts_with(src_ip, '10.0.99.') and (dst_port = 6379 or bytes > 500000))) "
    "select flow_id, 'east_west' as detector, 'WEB_APP_THREAT' as category, case when metadata then 'CRITICAL' else 'HIGH' end as severity, case when metadata then 0.99 else 0.86 end::double as confidence, bytes::double as evidence, "
    "case when metadata then concat_ws('|', 'metadata', src_ip, dst_ip) else concat_ws('|', 'database', src_ip, dst_port) end as key from f"
)
def w22_east_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = spark.sql(_INNER.replace("{flows}", "{view}"), view=flow_view(spark, sf_dir))
    return sessions_l7.east_west(inner).select(*FIRED, "key")


@query(
    view_sql("tickets")
    + ", k as (select *, case when len(services) > 0 then array_to_string(services, '/') else 'ServiceAccount' end as service from tickets where message = 'TGS-REQ' and rc4), "
    + f"w as (select *, count(*) {_over('src_ip', 60)} as n, len(list_distinct(list(service) {_over('src_ip', 60)})) as n_services from k) "
    + "select flow_id, 'asrep_roasting' as detector, 'IDENTITY_ATTACK' as category, 'HIGH' as severity, 0.88::double as confidence, 1::double as evidence from tickets where message = 'AS-REQ' and not preauth union all "
    + "select flow_id, 'kerberoasting', 'IDENTITY_ATTACK', 'CRITICAL', 0.96::double, n::double from w where n_services >= 2 or contains(service, 'MSSQLSvc') or n >= 3"
)
def w12_kerberos_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_l7.kerberos_attacks(message_view(spark, sf_dir, "tickets")).select(*FIRED)


@query(
    view_sql("calls")
    + " select flow_id, 'rpc' as detector, case interface when 'drsuapi' then 'IDENTITY_ATTACK' else 'LATERAL_MOVEMENT' end as category, case interface when 'drsuapi' then 'CRITICAL' else 'HIGH' end as severity, "
    + "case interface when 'drsuapi' then 0.98 else 0.92 end::double as confidence, 1::double as evidence from calls where interface in ('drsuapi', 'svcctl')"
)
def w14_rpc_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_l7.rpc_attacks(message_view(spark, sf_dir, "calls")).select(*FIRED)


@query()
def w6_domain_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_l7.domain_threats(flow_view(spark, sf_dir)).select(*FIRED)


@query(
    view_sql("answers")
    + ", r as (select rtrim(trim(lower(domain)), '.') as domain, ttl, t_us, unnest(ips) as ip from answers), n as (select *, array_to_string(string_split(ip, '.')[1:3], '.') as net from r), "
    + f"w as (select *, len(list_distinct(list(ip) {_over('domain', 3600)})) as n_ips, len(list_distinct(list(net) {_over('domain', 3600)})) as n_nets, avg(ttl) {_over('domain', 3600)} as mean_ttl from n) "
    + "select distinct domain, t_us, n_ips, n_nets, round(mean_ttl, 6) as mean_ttl from w where n_ips >= 4 and mean_ttl <= 300 and n_nets >= 3"
)
def w11_fast_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions_l7.fast_flux(message_view(spark, sf_dir, "answers")).withColumn("mean_ttl", F.round("mean_ttl", 6))


_V5_ADDRESS = "concat_ws('.', cast(flow_id % 200 + 1 as varchar), '0', '113', cast(bytes % 250 as varchar))"


@query(
    f"select {_V5_ADDRESS} as src_ip, '10.0.0.1' as dst_ip, src_port, dst_port, protocol, tcp_flags, packets, bytes % 4000000000 as bytes from flows"
)
def s1_netflow_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows encoded as datagrams of one record each, and decoded."""
    be = wire.big_endian
    flows = flow_view(spark, sf_dir)
    source = F.concat(be(F.col("flow_id") % 200 + 1, 1), F.lit("0071"), be(F.col("bytes") % 250, 1))
    head = F.concat(F.lit("00050001"), be(F.lit(600_000), 4), be(F.floor(F.col("t_us") / 1_000_000), 4), F.lit("00" * 12))
    sizes = F.concat(be(F.col("packets"), 4), be(F.col("bytes") % 4_000_000_000, 4), be(F.lit(500_000), 4), be(F.lit(550_000), 4))
    tail = F.concat(be(F.col("src_port"), 2), be(F.col("dst_port"), 2), F.lit("00"), be(F.col("tcp_flags"), 1), be(F.col("protocol"), 1), F.lit("00" * 9))
    packets = flows.select(F.lit("exporter").alias("exporter"), F.unhex(F.concat(head, source, F.lit("0A000001" "00000000" "00010002"), sizes, tail)).alias("data"))
    return netflow.decode(packets).select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "packets", "bytes")


@query(
    "select case when flow_id % 3 = 0 then null else src_ip end as src_ip, dst_ip, cast(case when flow_id % 4 = 0 then 45000 else src_port end as int) as src_port, dst_port, "
    "cast(case when flow_id % 5 = 0 then 6 else protocol end as int) as protocol, cast(case when flow_id % 7 = 0 then 1500 else bytes end as bigint) as bytes, cast(packets as bigint) as packets from flows"
)
def s11_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as JSON texts that lack a field now and then, read with the hook's defaults."""
    flows = flow_view(spark, sf_dir)
    lacks = {"src_ip": 3, "src_port": 4, "protocol": 5, "bytes": 7}
    fields = [F.when(F.col("flow_id") % lacks[c] != 0, F.col(c)).alias(c) if c in lacks else F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "packets", "tcp_flags")]
    return feeds.telemetry(flows.select(F.to_json(F.struct(*fields)).alias("value"))).select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes", "packets")


_MAC = "concat('aa:bb:cc:00:00:', lower(printf('%02x', flow_id % 256)))"


@query(
    f"select flow_id, case when flow_id % 9 <> 0 then {_MAC} end as mac, case when flow_id % 9 <> 0 then concat('10.0.7.', cast(flow_id % 250 as varchar)) end as ip, "
    "cast(case when flow_id % 9 = 0 then null else 1 + flow_id % 8 end as int) as message_type, case when flow_id % 9 <> 0 and flow_id % 4 <> 0 then concat('host-', cast(flow_id % 100 as varchar)) end as hostname from flows"
)
def e4_dhcp_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with padding and options in turn; every ninth has a wrong magic number."""
    be = wire.big_endian
    name = F.concat(F.lit("host-"), (F.col("flow_id") % 100).cast("string"))
    head = F.concat(F.lit("020106" + "00" * 13 + "0A0007"), be(F.col("flow_id") % 250, 1), F.lit("00" * 8 + "AABBCC0000"), be(F.col("flow_id") % 256, 1), F.lit("00" * 202))
    magic = F.when(F.col("flow_id") % 9 == 0, F.lit("00000000")).otherwise(F.lit("63825363"))
    host = F.when(F.col("flow_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("0C"), be(F.octet_length(name), 1), F.hex(name.cast("binary"))))
    options = F.concat(F.lit("0000" "3501"), be(F.col("flow_id") % 8 + 1, 1), F.lit("3604C0A80001"), host, F.lit("FF0C0141"))
    data = F.unhex(F.concat(head, magic, options))
    messages = flow_view(spark, sf_dir).select("flow_id", data.alias("data"))
    return messages.select("flow_id", wire.dhcp(F.col("data")).alias("m")).select("flow_id", "m.mac", "m.ip", "m.message_type", "m.hostname")


def _hex_ip(ip: str) -> str:
    return "concat(" + ", ".join(f"printf('%02X', cast(split_part({ip}, '.', {n}) as int))" for n in range(1, 5)) + ")"


_TEXT = "concat('evidence alert:', alert_id, ' category:', category, ' packet:', cast(i + 1 as varchar))"
_LE = "concat(" + ", ".join(f"substr(printf('%08X', {{0}}), {n}, 2)" for n in (7, 5, 3, 1)) + ")"


@query(
    ALERTS_SQL
    + f", q as (select *, {_TEXT} as said from alerts, range(5) t(i)), "
    + "s as (select *, octet_length(encode(said)) as size, t_us + i * 100000 as us from q), "
    + f"f as (select *, concat('{evidence.ETHERNET}', '4500', printf('%04X', size + case when protocol = 17 then 28 else 40 end), '1234400040', printf('%02X', protocol), '0000', {_hex_ip('src_ip')}, {_hex_ip('dst_ip')}, "
    + "printf('%04X', 49152 + i), printf('%04X', dst_port), case when protocol = 17 then concat(printf('%04X', size + 8), '0000') else concat(printf('%08X', 10000 + i * 1000), '0000000050', '02', 'FAF000000000') end, hex(encode(said))) as frame from s), "
    + f"r as (select alert_id, i, concat({_LE.format('cast(us // 1000000 as bigint)')}, {_LE.format('cast(us % 1000000 as bigint)')}, {_LE.format('cast(length(frame) // 2 as bigint)')}, {_LE.format('cast(length(frame) // 2 as bigint)')}, frame) as record from f) "
    + f"select alert_id, count(*) as n_packets, sha256(unhex(concat('{evidence.FILE_HEADER}', string_agg(record, '' order by i)))) as sha256 from r group by 1"
)
def k9_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.captures(evidence.frames(alert_view(spark, sf_dir))).select("alert_id", "n_packets", "sha256")


@query(ALERTS_SQL + " select alert_id, case when category in ('MALICIOUS_C2', 'EXFILTRATION', 'C2_BEACONING') then dst_ip else src_ip end as target_ip, "
       "concat('quarantine-', lower(substr(alert_id, 1, 8))) as name from alerts")  # fmt: skip
def r5_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = response.policies(alert_view(spark, sf_dir))
    return out.select("alert_id", "target_ip", F.regexp_extract("quarantine", r"name: (\S+)", 1).alias("name"))


@query("select count(*) as clusters, count_if(status = 'ONLINE') as online, round(sum(case when status = 'ONLINE' then mbps end), 2) as mbps, cast(sum(alerts) as bigint) as alerts from "
       "(select src_ip, case when src_ip like '%7' then 'OFFLINE' else 'ONLINE' end as status, sum(bytes) * 8 / 1e6 as mbps, count_if(flow_id % 13 = 0) as alerts from flows group by 1) c")  # fmt: skip
def a22_federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = flow_view(spark, sf_dir).groupBy(F.col("src_ip").alias("cluster_id")).agg((F.sum("bytes") * 8 / 1e6).alias("mbps"), F.count_if(F.col("flow_id") % 13 == 0).alias("alerts"))
    return analytics.federation(clusters.withColumn("status", F.when(F.col("cluster_id").endswith("7"), "OFFLINE").otherwise("ONLINE")))


@query("select ip, family from (select * from (values ('198.51.100.77', 'c2'), ('10.1.0.80', 'old')) i(ip, family) where ip not in ('10.1.0.80')) i union all select distinct dst_ip, 'custom' from flows where dst_ip like '10.1.0.4_' and dst_ip <> '10.1.0.44'")
def u3_edited_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    iocs = spark.createDataFrame([("198.51.100.77", "c2"), ("10.1.0.80", "old"), ("10.1.0.41", "replaced")], "ip string, family string")
    added = flow_view(spark, sf_dir).where(F.col("dst_ip").like("10.1.0.4_")).select(F.col("dst_ip").alias("ip"), F.lit("custom").alias("family")).distinct()
    return intel.edited(iocs, added, spark.createDataFrame([("10.1.0.80",), ("10.1.0.44",)], "ip string"))


_SIGHTING = (
    "select case when flow_id % 4 = 0 then concat('AA-BB-', cast(user_no as {text})) end as mac, case when flow_id % 3 = 0 then concat('Host', cast(user_no as {text})) end as hostname, src_ip as ip, t_us "
    "from (select *, flow_id % 60 as user_no from {flows}) s"
)


@query(
    f", s as ({_SIGHTING.format(text='varchar', flows='flows')}), r as (select replace(lower(mac), '-', ':') as mac, lower(hostname) as hostname, ip, t_us from s), "
    "hm as (select hostname, arg_max(mac, (t_us, mac)) as host_mac from r where mac is not null and hostname is not null group by 1), im as (select ip, arg_max(mac, (t_us, mac)) as ip_mac from r where mac is not null group by 1), "
    "j as (select r.*, coalesce(mac, host_mac, case when r.hostname is null then ip_mac end) as m from r left join hm using (hostname) left join im using (ip)), "
    "k as (select *, coalesce('mac:' || m, 'host:' || hostname, 'ip:' || ip) as entity from j) "
    "select entity, arg_max(ip, (t_us, ip)) as ip, arg_max(hostname, (t_us, hostname)) filter (hostname is not null) as hostname, min(t_us) as first_us, max(t_us) as last_us, count(*) as sightings from k group by 1"
)
def e1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.entities(spark.sql(_SIGHTING.format(text="string", flows="{flows}"), flows=flow_view(spark, sf_dir)))


@query(
    ALERTS_SQL
    + ", x as (select src_ip as ip, 5.0 * count_if(severity = 'LOW') + 15 * count_if(severity = 'MEDIUM') + 35 * count_if(severity = 'HIGH') + 60 * count_if(severity = 'CRITICAL') as score from alerts group by 1) "
    "select ip, cast(least(100, score) as double) as score from x where score >= 50 order by least(100, score) desc, ip limit 50"
)
def e3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = hosts.lookup(F.col("severity"), {"LOW": 5.0, "MEDIUM": 15.0, "HIGH": 35.0, "CRITICAL": 60.0}, 0.0)
    scores = alert_view(spark, sf_dir).groupBy(F.col("src_ip").alias("ip")).agg(F.least(F.lit(100.0), F.sum(points)).alias("score")).withColumn("role", F.lit("WORKSTATION"))
    return hosts.ranking(scores, least=50.0).select("ip", "score")
