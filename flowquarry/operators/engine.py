"""All detectors over one flow table, in order, as alerts with techniques, controls and campaigns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions import wire
from flowquarry.operators import correlate, detect, dims, hosts, intel, ml, report, sessions_l7, sigma
from flowquarry.operators.biflow import running_ratio
from flowquarry.sources.cut import stored
from flowquarry.sources.messages import dns_message, tls_hello

#: The place of each step in the order in which a flow meets them; a web rule is named ``web:...``.
STEPS = (
    ("indicator", "indicator_filter"),
    ("port_scan",),
    ("syn_flood",),
    ("bandwidth_exfil",),
    ("dns_volume",),
    ("beaconing",),
    ("lateral_movement",),
    ("encrypted_exfil", "encrypted_beacon", "splt"),
    ("sigma",),
    ("east_west",),
    ("domain", "fast_flux", "fingerprint", "asrep_roasting", "kerberoasting", "rpc", "web"),
    ("deviation",),
    ("plugin",),
    ("campaign",),
)
#: Ports where DNS, TLS, Kerberos, RPC and HTTP messages are looked for.
DNS_PORT, TLS_PORTS, KERBEROS_PORT, RPC_PORTS, HTTP_PORTS = 53, (443, 8443), 88, (135, 445), (80, 8080, 8000, 3000, 5000, 443, 8443)
#: A fingerprint's confidence.
FINGERPRINT_CONFIDENCE = 0.95

Plugin = Callable[[DataFrame], DataFrame]


def rule_order(detector: Column) -> Column:
    """The place of a detector's step, from 1."""
    name = F.split_part(detector, F.lit(":"), F.lit(1))
    return reduce(lambda c, step: c.when(name.isin(*step[1]), step[0]), enumerate(STEPS[1:], 2), F.when(name.isin(*STEPS[0]), 1))


def sigma_fired(flows: DataFrame, rules: tuple[sigma.Rule, ...] = sigma.SHIPPED) -> DataFrame:
    """Matches of declarative rules, with the conversation's ratio as of each flow."""
    ratio = flows if "ratio" in flows.columns else running_ratio(flows)
    found = sigma.evaluate(sigma.with_context(ratio, F.col("ratio")), rules, keep=("protocol",))
    return detect.fires(found, "sigma", "ANOMALY_ML", F.col("severity"), F.col("confidence"), 0, ["rule_id", "src_ip", "dst_ip"], F.lit(1))


def _flow(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select("flow_id", "t_us", "src_ip", "dst_ip", "dst_port", "protocol", *more)


def message_fired(flows: DataFrame) -> DataFrame:
    """What a flow's application message fires: names, fingerprints, tickets, calls and web requests.

    A flow's payload is decoded where its port, its first byte or its first word says so, each kind once.
    """
    flows = flows if "domain" in flows.columns else flows.withColumn("domain", F.lit(None).cast("string"))
    names = _flow(flows.where("domain is not null"), "domain")
    if "payload" not in flows.columns:
        return sessions_l7.domain_threats(names)
    sent = flows.where("length(payload) > 0")
    on = lambda *ports: F.col("dst_port").isin(*ports)
    dns = _flow(sent.where(on(DNS_PORT) | (F.col("src_port") == DNS_PORT) | F.col("domain").isNotNull()), dns_message(F.col("payload")).alias("dns"), F.col("domain").alias("known"))
    dns = dns.where("dns.domain is not null")
    asked = _flow(dns.where("known is null or known <> dns.domain"), F.col("dns.domain").alias("domain"))
    fired = sessions_l7.domain_threats(names.unionByName(asked))
    answers = dns.where("dns.response and size(dns.ips) > 0").select(F.col("dns.domain").alias("domain"), F.col("dns.ips").alias("ips"), F.coalesce("dns.ttl", F.lit(30)).alias("ttl"), "t_us")
    flux = sessions_l7.fast_flux(answers)
    seen = dns.withColumn("domain", sessions_l7.cleaned(F.col("dns.domain"))).join(flux.select("domain", "t_us", "n_ips"), ["domain", "t_us"])
    fired = fired.unionByName(detect.fires(seen, "fast_flux", "DGA_DOMAIN", F.lit("HIGH"), F.lit(0.92), 0, ["domain"], F.col("n_ips")))
    first = F.hex(F.substring(F.col("payload"), F.lit(1), F.lit(1)))
    hello = _flow(sent.where(on(*TLS_PORTS) | (first == "16")), tls_hello(F.col("payload")).alias("hello")).where("hello.version is not null")
    prints = hello.withColumns({"ja4": wire.ja4(F.col("hello")), "ja3": wire.ja3(F.col("hello"))})
    known = intel.match_fingerprints(prints, dims.fingerprints(flows.sparkSession), dims.BENIGN_JA4).where("family is not null")
    fired = fired.unionByName(detect.fires(known, "fingerprint", "ANOMALOUS_TLS", F.col("severity"), F.lit(FINGERPRINT_CONFIDENCE), 0, ["ja4", "src_ip", "dst_ip"], F.lit(1)))
    tickets = _flow(sent.where(on(KERBEROS_PORT)), wire.kerberos(F.col("payload")).alias("k")).where("k is not null")
    fired = fired.unionByName(sessions_l7.kerberos_attacks(_flow(tickets, "k.*")))
    calls = _flow(sent.where(on(*RPC_PORTS)), wire.rpc_interface(F.col("payload")).alias("interface")).where("interface is not null")
    fired = fired.unionByName(sessions_l7.rpc_attacks(calls))
    method = F.split_part(F.decode(F.substring(F.col("payload"), F.lit(1), F.lit(8)), "ISO-8859-1"), F.lit(" "), F.lit(1))
    web = _flow(sent.where(on(*HTTP_PORTS) | method.isin(*wire.HTTP_METHODS)), wire.http_request(F.col("payload")).alias("h")).where("h is not null")
    return fired.unionByName(sessions_l7.web_alerts(_flow(web, "h.*")))


def fired_rows(
    flows: DataFrame,
    networks: list[tuple[str, str]] | None = None,
    rules: tuple[sigma.Rule, ...] = sigma.SHIPPED,
    plugins: Sequence[Plugin] = (),
    host_roles: DataFrame | None = None,
    packets: DataFrame | None = None,
) -> DataFrame:
    """Rows of every step but the last two, after their cooldowns; flows are given their past unless they have it."""
    spark = flows.sparkSession
    flows = flows if {"n_before", "ratio"} <= set(flows.columns) else detect.with_past(flows)
    known_roles = hosts.roles(flows) if host_roles is None else host_roles
    steps = [intel.indicator_alerts(flows, dims.malicious_ips(spark), networks or [], dims.seed_iocs(spark))]
    roles = {detect.lateral_movement: {"roles": known_roles}}
    steps += [d(flows, over=detect.KNOWN, **roles.get(d, {})) for d in detect.DETECTORS]
    steps += [] if packets is None else [sessions_l7.splt_beacons(sessions_l7.packet_lengths(packets))]
    steps += [sigma_fired(flows, rules), sessions_l7.east_west(flows), message_fired(flows)]
    steps += [p(flows).withColumn("detector", F.concat(F.lit("plugin:"), F.col("detector"))) for p in plugins]
    return detect.with_cooldown(stored(reduce(DataFrame.unionByName, steps), "fired-before-cooldowns"))


def alerts(
    flows: DataFrame,
    networks: list[tuple[str, str]] | None = None,
    rules: tuple[sigma.Rule, ...] = sigma.SHIPPED,
    plugins: Sequence[Plugin] = (),
    host_roles: DataFrame | None = None,
    baseline: DataFrame | None = None,
    packets: DataFrame | None = None,
) -> DataFrame:
    """Alerts of ``flows``, which may hold ``payload`` bytes: fired rows with ``rule_order``, ``alert_id``, technique and controls.

    With ``packets``, rows like flows of one packet each, conversations are also judged by their packets' lengths.

    A flow that no rule fires on is held against a baseline of all flows, or the one given, as
    ``ml.baseline_stats`` makes it. What a flow's source and conversation did before is worked out once and written beside the flows, from
    where each step scans the columns and rows it needs; fired rows are written once as well. A source whose alerts reach a further set of stages within a quarter of an
    hour also makes a campaign. Sort by t_us, flow_id and rule_order for the order of a live system.
    """
    spark = flows.sparkSession
    flows = stored(detect.with_past(flows), "flows-with-past")
    fired = stored(fired_rows(flows, networks, rules, plugins, host_roles, packets), "fired")
    ruled = fired.where(~F.col("detector").startswith("plugin:"))
    rest = ml.features(flows).join(ruled.select("flow_id").distinct(), "flow_id", "left_anti")
    odd = ml.deviations(rest, ml.baseline_stats(ml.features(flows)) if baseline is None else baseline)
    severity = F.when(F.col("z_bytes") > 10, "HIGH").otherwise("MEDIUM")
    confidence = F.least(F.lit(0.95), 0.7 + F.greatest("z_bytes", "z_packets") / 100)
    every = fired.unionByName(detect.fires(odd, "deviation", "ANOMALY_ML", severity, confidence, 0, ["src_ip", "dst_ip"], F.greatest("z_bytes", "z_packets")))
    every = stored(every.withColumn("alert_id", F.sha2(F.concat_ws("|", "detector", "key", "flow_id"), 256)), "alerts")
    chains = correlate.kill_chain(every)
    first = every.join(chains.select("alert_id", "progression", "n_alerts"), "alert_id")
    campaign = {
        "detector": F.lit("campaign"),
        "category": F.lit("ATTACK_CAMPAIGN"),
        "severity": F.lit("CRITICAL"),
        "confidence": F.lit(0.99),
        "key": F.concat_ws("|", "src_ip", "progression"),
        "evidence": F.col("n_alerts").cast("double"),
        "alert_id": F.sha2(F.concat_ws("|", F.lit("campaign"), "src_ip", "progression"), 256),
    }
    made = first.select(*[campaign[c].alias(c) if c in campaign else F.col(c) for c in every.columns])
    out = every.unionByName(made).withColumns({"rule_order": rule_order(F.col("detector")), "status": F.lit("NEW")})
    return report.with_controls(report.with_techniques(out, dims.mitre(spark)), dims.controls(spark))
