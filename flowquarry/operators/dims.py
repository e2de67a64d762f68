"""Small reference tables: techniques, controls, indicators and fingerprints."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alert severities by rank.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Category, tactic, technique, its name, sub-technique.
MITRE = (
    ("PORT_SCAN", "Discovery", "T1046", "Network Service Discovery", None),
    ("SYN_FLOOD", "Impact", "T1498", "Network Denial of Service", "T1498.001"),
    ("EXFILTRATION", "Exfiltration", "T1048", "Exfiltration Over Alternative Protocol", "T1048.003"),
    ("DNS_TUNNEL", "Command and Control", "T1071", "Application Layer Protocol", "T1071.004"),
    ("MALICIOUS_C2", "Command and Control", "T1071", "Application Layer Protocol", None),
    ("ANOMALY_ML", "Defense Evasion", "T1036", "Masquerading / Baseline Anomaly", None),
    ("C2_BEACONING", "Command and Control", "T1071", "Application Layer Protocol: C2 Beaconing", "T1071.001"),
    ("ATTACK_CAMPAIGN", "Enterprise Kill Chain", "T1046+T1071+T1048", "Multi-Stage Attack Campaign", None),
    ("LATERAL_MOVEMENT", "Lateral Movement", "T1021", "Remote Services", "T1021.002"),
    ("ANOMALOUS_TLS", "Command and Control", "T1573", "Encrypted Channel", "T1573.001"),
    ("DGA_DOMAIN", "Command and Control", "T1568", "Dynamic Resolution", "T1568.002"),
    ("IDENTITY_ATTACK", "Credential Access", "T1558", "Steal or Forge Kerberos Tickets", "T1558.003"),
    ("WEB_APP_THREAT", "Initial Access / Credential Access", "T1190", "Exploit Public-Facing Application & Credential Abuse", "T1110.001"),
)
#: Standards, and the requirement of each that a category bears on.
STANDARDS = ("PCI-DSS v4.0", "ISO/IEC 27001:2022", "NIST CSF 2.0", "CIS Controls v8")
CONTROLS = {
    "PORT_SCAN": ("Req 11.4.1", "Control A.8.16", "DE.CM-01", "Control 13.1"),
    "SYN_FLOOD": ("Req 11.4.1", "Control A.8.20", "DE.AE-02", "Control 13.2"),
    "EXFILTRATION": ("Req 10.4.1 / 11.4", "Control A.8.23", "DE.CM-01 / PR.DS-05", "Control 13.3"),
    "DNS_TUNNEL": ("Req 11.4.1", "Control A.8.23", "DE.CM-01", "Control 13.3"),
    "MALICIOUS_C2": ("Req 11.4.1", "Control A.8.16 / A.8.20", "DE.CM-01 / RS.AN-01", "Control 13.1"),
    "ANOMALY_ML": ("Req 10.4.1", "Control A.8.16", "DE.AE-02", "Control 13.2"),
    "C2_BEACONING": ("Req 11.4.1", "Control A.8.16", "DE.CM-01", "Control 13.3"),
    "ATTACK_CAMPAIGN": ("Req 12.10.1", "Control A.5.24", "RS.AN-01", "Control 17.1"),
    "LATERAL_MOVEMENT": ("Req 1.2.1", "Control A.8.20", "PR.AC-05", "Control 12.2"),
    "ANOMALOUS_TLS": ("Req 11.4.1", "Control A.8.20 / A.8.23", "DE.CM-01", "Control 13.3"),
    "DGA_DOMAIN": ("Req 11.4.1", "Control A.8.23", "DE.CM-01", "Control 13.3"),
    "IDENTITY_ATTACK": ("Req 10.4.1 / Req 11.4.1", "Control A.8.16 / Control A.9.4", "PR.AC-07", "Control 6.8"),
    "WEB_APP_THREAT": ("Req 6.4.2", "Control A.8.26", "PR.AC-07", "Control 16.1"),
}
#: Address, family, actor, severity of the first feed.
MALICIOUS_IPS = (
    ("198.51.100.77", "Cobalt Strike C2", "APT29", "CRITICAL"),
    ("185.220.101.5", "Tor Exit Node / Scanner", "Unknown", "HIGH"),
    ("45.33.32.156", "Mirai Botnet C2", "Botnet Operator", "CRITICAL"),
    ("194.26.29.112", "QakBot Loader", "TA577", "CRITICAL"),
)
#: Address, threat, actor, confidence of the second feed.
SEED_IOCS = (
    ("198.51.100.77", "Cobalt Strike C2", "APT29", 0.98),
    ("198.51.100.200", "Sliver C2 Server", "FIN7", 0.95),
    ("203.0.113.50", "Emotet Botnet Node", "TA542", 0.96),
    ("203.0.113.66", "QakBot C2 Controller", "BlackBasta", 0.97),
)
#: Fingerprint, family, actor, severity, technique of known TLS clients.
JA4 = (
    ("t13d1516h2_8daaf6152771_e562703ab855", "Cobalt Strike C2", "APT29 / Multiple", "CRITICAL", "T1071.001"),
    ("t12d190800_2b7b7fa6f157_26279f15d2a9", "Cobalt Strike C2", "FIN7", "CRITICAL", "T1071.001"),
    ("t13d2112h2_40f064c5a92a_c4c2a3782b5e", "Sliver C2", "BishopFox / Red Team", "CRITICAL", "T1071.001"),
    ("t13i190800_40f064c5a92a_e562703ab855", "Sliver C2", "Unknown Threat Actor", "CRITICAL", "T1071.001"),
    ("t12d170800_3b1d9c12e87a_14f3b79a5281", "Metasploit Meterpreter", "Offensive Operators", "CRITICAL", "T1573.002"),
    ("t12i010000_000000000000_000000000000", "Recon Tool / SSL Scanner", "Security Scanner", "MEDIUM", "T1046"),
)
JA3 = (
    ("a0e9f5d64349fb13191bc781f81f42e1", "Metasploit Meterpreter", "Offensive Operators", "CRITICAL", "T1573.002"),
    ("72a589da586844d7f0818ce684948eea", "Cobalt Strike C2", "APT29", "CRITICAL", "T1071.001"),
    ("6734f37431670b3ab4292b8f60f29984", "TrickBot / Emotet", "Wizard Spider", "CRITICAL", "T1071.001"),
)
#: First parts of fingerprints of common browsers and tools.
BENIGN_JA4 = ("t13d1516h2", "t13d1715h2", "t13d1615h2", "t13d1413h2", "t13d030400")


def table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small fixed table that the planner knows the size of, so that it is broadcast."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return spark.createDataFrame(pa.table(dict(zip(names, map(pa.array, columns), strict=True)))).select(*[F.col(n).cast(c.split()[1]) for n, c in zip(names, schema.split(", "), strict=True)])


def mitre(spark: SparkSession) -> DataFrame:
    return table(spark, MITRE, "category string, tactic string, technique_id string, technique_name string, subtechnique_id string")


def controls(spark: SparkSession) -> DataFrame:
    rows = [(c, s, r) for c, needs in CONTROLS.items() for s, r in zip(STANDARDS, needs, strict=True)]
    return table(spark, rows, "category string, standard string, requirement_id string")


def malicious_ips(spark: SparkSession) -> DataFrame:
    return table(spark, MALICIOUS_IPS, "ip string, family string, actor string, severity string")


def seed_iocs(spark: SparkSession) -> DataFrame:
    return table(spark, SEED_IOCS, "ip string, family string, actor string, confidence double")


def fingerprints(spark: SparkSession) -> DataFrame:
    rows = [("ja4", *r) for r in JA4] + [("ja3", *r) for r in JA3]
    return table(spark, rows, "kind string, fingerprint string, family string, actor string, severity string, technique_id string")
