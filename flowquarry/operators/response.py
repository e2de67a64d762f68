"""Playbooks, containment, subscriptions and filter rules: what an alert asks for, as text. Nothing is executed."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.dims import SEVERITIES
from flowquarry.operators.hosts import lookup

#: Categories whose destination is what to block, and those that are contained at HIGH.
BLOCK_DESTINATION = ("MALICIOUS_C2", "EXFILTRATION", "C2_BEACONING")
ISOLATE = ("ATTACK_CAMPAIGN", "LATERAL_MOVEMENT")
CONTAINED_AT_HIGH = ("MALICIOUS_C2", "LATERAL_MOVEMENT", "EXFILTRATION")
RANK = {s: n for n, s in enumerate(SEVERITIES)}


def target() -> Column:
    return F.when(F.col("category").isin(*BLOCK_DESTINATION), F.col("dst_ip")).otherwise(F.col("src_ip"))


def playbooks(alerts: DataFrame) -> DataFrame:
    """One row per alert and platform: ``(alert_id, target_ip, impact, platform, block, rollback)``."""
    ip = target()
    impact = (
        F.when(F.col("category").isin(*BLOCK_DESTINATION), "LOW")
        .when(F.col("category").isin(*ISOLATE), "HIGH")
        .when(ip.startswith("10.") | ip.startswith("192.168."), "MEDIUM")
        .otherwise("LOW")
    )
    texts = {
        "iptables": ("iptables -I INPUT 1 -s %1$s -j DROP && iptables -I FORWARD 1 -s %1$s -j DROP", "iptables -D INPUT -s %1$s -j DROP && iptables -D FORWARD -s %1$s -j DROP"),
        "nftables": ("nft add element inet filter blackhole { %1$s }", "nft delete element inet filter blackhole { %1$s }"),
        "cisco": ("ip access-list extended ISOLATION\n 1 deny ip host %1$s any log", "ip access-list extended ISOLATION\n no 1 deny ip host %1$s any log"),
        "aws_nacl": ('{"RuleAction":"deny","RuleNumber":50,"CidrBlock":"%1$s/32","Egress":false}', '{"RuleNumber":50,"Egress":false,"Delete":true}'),
        "exabgp": ("announce flow route { match { source %1$s/32; } then { discard; } }", "withdraw flow route { match { source %1$s/32; } }"),
    }
    rows = F.array(*[F.struct(F.lit(p).alias("platform"), F.format_string(b, "target_ip").alias("block"), F.format_string(r, "target_ip").alias("rollback")) for p, (b, r) in texts.items()])
    named = alerts.select("alert_id", ip.alias("target_ip"), impact.alias("impact"))
    return named.select("alert_id", "target_ip", "impact", F.explode(rows).alias("p")).select("alert_id", "target_ip", "impact", "p.*")


def containments(alerts: DataFrame) -> DataFrame:
    """Alerts sure and severe enough to contain at once, with the address to isolate."""
    sure = ((F.col("severity") == "CRITICAL") & (F.col("confidence") >= 0.90)) | (
        (F.col("severity") == "HIGH") & (F.col("confidence") >= 0.95) & F.col("category").isin(*CONTAINED_AT_HIGH)
    )
    return alerts.where(sure).select("alert_id", target().alias("target_ip"), "severity", "category", "confidence")


def deliveries(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``(alert_id, subscriber)`` for each alert at or above a subscription's least severity.

    There are four severities, so the comparison is an equality on each level that a subscription admits.
    """
    levels = F.explode(F.filter(F.array(*[F.lit(s) for s in SEVERITIES]), lambda s: lookup(s, RANK, 0) >= lookup(F.col("least"), RANK, 0)))
    return alerts.select("alert_id", "severity").join(subscriptions.select("subscriber", levels.alias("severity")), "severity").select("alert_id", "subscriber")


def flowspec(alerts: DataFrame) -> DataFrame:
    """``(alert_id, action, match, junos)``: filter rules for routers by what kind of attack it is."""
    action = F.when(F.col("category") == "SYN_FLOOD", "RATE_LIMIT").otherwise("DROP")
    ends = {
        "source": F.when(~F.col("category").isin(*BLOCK_DESTINATION, "SYN_FLOOD"), F.concat("src_ip", F.lit("/32"))),
        "destination": F.when(F.col("category").isin(*BLOCK_DESTINATION, "SYN_FLOOD"), F.concat("dst_ip", F.lit("/32"))),
        "protocol": F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "udp"),
        "port": F.when(F.col("category").isin("SYN_FLOOD", "DNS_TUNNEL"), F.concat(F.lit("="), F.col("dst_port").cast("string"))),
    }
    match = F.concat_ws("; ", *[F.concat(F.lit(f"{k} "), v) for k, v in ends.items()])
    then = F.when(action == "DROP", "discard").otherwise("rate-limit 1000000")
    junos = F.concat(F.lit("route alert-"), "alert_id", F.lit(" { match { "), match, F.lit("; } then { "), then, F.lit("; } }"))
    return alerts.select("alert_id", action.alias("action"), match.alias("match"), junos.alias("junos"))


def signature(body: bytes, secret: bytes) -> str:
    """The signature header of a webhook call."""
    return "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()


def hmac_sha256(body: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 of a text or binary column in lower-case hexadecimal, from two digests with padded keys in front."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def signed_deliveries(alerts: DataFrame, secret: bytes, event: str = "security_alert") -> DataFrame:
    """``(alert_id, event, body, signature)``: what is posted to a webhook for each alert, signed where the alerts are."""
    body = F.to_json(F.struct("alert_id", "category", "severity", "src_ip", "dst_ip", "dst_port", "confidence"))
    made = alerts.select("alert_id", F.lit(event).alias("event"), body.alias("body"))
    return made.withColumn("signature", F.concat(F.lit("sha256="), hmac_sha256(F.col("body"), secret)))


def policies(alerts: DataFrame, namespace: str = "production") -> DataFrame:
    """``(alert_id, target_ip, quarantine, isolation)``: cluster policies that cut off the target, as manifests."""
    quarantine = (
        "apiVersion: cilium.io/v2\nkind: CiliumNetworkPolicy\nmetadata:\n  name: quarantine-%1$s\n  namespace: %3$s\nspec:\n"
        "  endpointSelector:\n    matchLabels:\n      io.kubernetes.pod.ip: \"%2$s\"\n  ingress:\n  - fromEndpoints:\n    - matchLabels:\n        app: forensics-agent\n"
        "  egress:\n  - toEntities:\n    - none\n"
    )
    isolation = "apiVersion: networking.k8s.io/v1\nkind: NetworkPolicy\nmetadata:\n  name: isolate-%1$s\n  namespace: %3$s\nspec:\n  podSelector:\n    matchLabels:\n      pod-ip: \"%2$s\"\n  policyTypes:\n  - Ingress\n  - Egress\n"
    named = alerts.select("alert_id", target().alias("target_ip"), F.lower(F.substring("alert_id", 1, 8)).alias("short"), F.lit(namespace).alias("namespace"))
    texts = [F.format_string(text, "short", "target_ip", "namespace").alias(name) for name, text in (("quarantine", quarantine), ("isolation", isolation))]
    return named.select("alert_id", "target_ip", *texts)
