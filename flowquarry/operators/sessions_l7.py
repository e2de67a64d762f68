"""Detectors on decoded application messages: HTTP requests, Kerberos and RPC messages, DNS answers."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions import wire
from flowquarry.functions.domains import cleaned, dga_score, entropy_verdict
from flowquarry.functions.net import canonical_pair
from flowquarry.operators.biflow import opener
from flowquarry.operators.blocks import quiet_segments
from flowquarry.operators.detect import FIRE, TLS_PORTS, fires, swept
from flowquarry.operators.dims import BENIGN_JA4

#: Endpoints, addresses, client names, ports and patterns that the web rules know.
AUTH_PATHS = ("/login", "/auth", "/signin", "/oauth", "/tokens", "/api/v1/auth", "/api/v1/login", "/api/v1/users/login", "/api/auth/callback", "/admin/login", "/user/login", "/session")
METADATA_IPS = ("169.254.169.254", "100.100.100.200", "192.0.0.192")
BOTS = {
    "sqlmap": "CRITICAL",
    "nikto": "HIGH",
    "nuclei": "HIGH",
    "wpscan": "MEDIUM",
    "masscan": "HIGH",
    "python-requests": "MEDIUM",
    "aiohttp": "MEDIUM",
    "go-http-client": "MEDIUM",
    "curl/": "LOW",
    "scrapy": "MEDIUM",
    "headlesschrome": "MEDIUM",
    "postmanruntime": "LOW",
}
WEB_COOLDOWN_US = 15_000_000
#: Longer than the longest window of the web rules, and than their cooldown.
WEB_PAUSE_US = 30_000_001
DATABASE_PORTS = (5432, 3306, 6379, 27017, 9200, 5672, 6443)
SQLI = ("' or '1'='1", "' or 1=1", '" or "1"="1', "union select", "union all select", "select * from", "drop table", "1=1--", "'--", "sleep(", "pg_sleep(", "benchmark(", "waitfor delay")
SENSITIVE = ("/.env", "/.git", "/wp-admin", "/phpmyadmin", "/id_rsa", "/etc/passwd", "/etc/shadow", "/.aws/credentials", "/docker-compose.yml", "/server.js.bak", "/database.sql")


def unquoted(text: Column) -> Column:
    """Percent escapes undone where they are well-formed; a plus sign stays."""
    guarded = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(guarded), text)


def _tenant(path: Column) -> Column:
    in_path = F.regexp_extract(path, r"/(?:tenants|orgs|workspaces)/([a-zA-Z0-9_\-]+)", 1)
    return F.coalesce(F.col("tenant"), F.when(in_path != "", in_path))


def _every(text: Column, patterns: tuple[str, ...]) -> Column:
    """All patterns that the text contains, in their order. The text is worked out once, not for each pattern."""
    found = lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(p)), F.lit(p)) for p in patterns]))
    return F.get(F.transform(F.array(text), found), F.lit(0))


def web_facts(requests: DataFrame) -> DataFrame:
    """``requests`` with what the web rules look at: path, tenant, sign_in, metadata, bots, injections and files found."""
    path = F.lower(F.coalesce("path", F.lit("/")))
    sign_in = F.col("method").isin("POST", "PUT") & reduce(lambda a, b: a | b, [(path == p) | path.startswith(p + "/") for p in AUTH_PATHS])
    host = F.coalesce("host", F.lit(""))
    metadata = F.col("dst_ip").isin(*METADATA_IPS) | reduce(lambda a, b: a | b, [F.contains(host, F.lit(ip)) for ip in METADATA_IPS])
    sent = F.lower(F.concat_ws(" ", unquoted(unquoted(F.coalesce("uri", F.lit("")))), unquoted(F.coalesce("body", F.lit("")))))
    facts = {
        "low_path": path,
        "seen_tenant": _tenant(path),
        "sign_in": F.coalesce(sign_in, F.lit(False)).cast("int"),
        "metadata": F.coalesce(metadata, F.lit(False)),
        "bots": _every(F.lower(F.coalesce("user_agent", F.lit(""))), tuple(BOTS)),
        "injections": _every(sent, SQLI),
        "files": _every(path, SENSITIVE),
    }
    return requests.withColumns(facts)


def web_threats(requests: DataFrame) -> DataFrame:
    """Fired rows of the web rules, before cooldowns, from ``requests`` with the HTTP struct's fields beside the flow columns.

    The rules are an ordered chain: a request fires the first that applies. Rate rules count all requests
    of the source in their window. :func:`web_alerts` runs the chain with its cooldowns.
    """
    rows = swept(web_facts(requests), ["src_ip"], 10, {"sign_ins": F.col("sign_in")})
    rows = swept(rows, ["src_ip"], 5, {"requests": F.lit(1)})
    rows = swept(rows, ["src_ip"], 30, distinct={"tenants": "seen_tenant"})
    bot, sqli, sensitive = F.get("bots", F.lit(0)), F.get("injections", F.lit(0)), F.get("files", F.lit(0))
    bot_severity = reduce(lambda c, kv: c.when(bot == kv[0], kv[1]), list(BOTS.items())[1:], F.when(bot == "sqlmap", "CRITICAL"))
    bot_fires = bot.isNotNull() & (bot_severity.isin("CRITICAL", "HIGH") | (F.col("requests") > 3))
    s = lambda rule, severity, confidence, key: F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), F.lit(confidence).alias("confidence"), key.alias("what"))
    verdict = (
        F.when(F.col("metadata"), s("ssrf_metadata", F.lit("CRITICAL"), 0.98, F.col("dst_ip")))
        .when((F.col("sign_in") == 1) & (F.col("sign_ins") >= 8), s("credential_stuffing", F.lit("CRITICAL"), 0.94, F.col("low_path")))
        .when(F.col("requests") >= 35, s("api_flood", F.lit("HIGH"), 0.91, F.lit("")))
        .when(F.col("seen_tenant").isNotNull() & (F.col("tenants") >= 3), s("tenant_hopping", F.lit("CRITICAL"), 0.95, F.lit("")))
        .when(bot_fires, s("bot_agent", bot_severity, 0.88, bot))
        .when(sqli.isNotNull(), s("sql_injection", F.lit("CRITICAL"), 0.97, sqli))
        .when(sensitive.isNotNull(), s("path_fuzzing", F.lit("HIGH"), 0.92, sensitive))
    )
    hit = rows.withColumn("v", verdict).where("v is not null").withColumns({"rule": F.col("v.rule"), "what": F.col("v.what")})
    return fires(hit, "web", "WEB_APP_THREAT", F.col("v.severity"), F.col("v.confidence"), 15, ["rule", "src_ip", "what"], F.col("requests")).withColumn("detector", F.concat(F.lit("web:"), F.split_part("key", F.lit("|"), F.lit(1))))


class _Source:
    """What the web rules remember of one source: requests in their windows, and when each key last fired."""

    def __init__(self) -> None:
        self.sign_ins, self.requests, self.tenants = deque(), deque(), deque()
        self.tenant_counts: Counter[str] = Counter()
        self.fired: dict[tuple[str, str], int] = {}

    def cools(self, key: tuple[str, str], t: int) -> bool:
        if t - self.fired.get(key, t - WEB_COOLDOWN_US) < WEB_COOLDOWN_US:
            return True
        if len(self.fired) > 1000:  # keys out of their cooldown say nothing any more
            self.fired = {k: at for k, at in self.fired.items() if t - at < WEB_COOLDOWN_US}
        self.fired[key] = t
        return False

    @staticmethod
    def within(window: deque, t: int, seconds: int) -> int:
        while window and t - window[0][0] > seconds * 1_000_000:
            window.popleft()
        return len(window)

    def tenants_within(self, tenant: str, t: int, seconds: int) -> int:
        """How many tenants the window holds with this request's, counted as they come and go."""
        self.tenants.append((t, tenant))
        self.tenant_counts[tenant] += 1
        while t - self.tenants[0][0] > seconds * 1_000_000:
            _, gone = self.tenants.popleft()
            self.tenant_counts[gone] -= 1
            if not self.tenant_counts[gone]:
                del self.tenant_counts[gone]
        return len(self.tenant_counts)

    def verdict(self, r) -> tuple[str, str, float, str, int] | None:
        """The first rule that applies and does not cool down; a rule that cools down lets the next ones try.

        A request that fired is not counted by the rules behind the one it fired.
        """
        t = r.t_us
        if r.metadata and not self.cools(("ssrf_metadata", r.dst_ip), t):
            return "ssrf_metadata", "CRITICAL", 0.98, r.dst_ip, 1
        if r.sign_in:
            self.sign_ins.append((t, None))
            n = self.within(self.sign_ins, t, 10)
            if n >= 8 and not self.cools(("credential_stuffing", r.low_path), t):
                return "credential_stuffing", "CRITICAL", 0.94, r.low_path, n
        self.requests.append((t, None))
        busy = self.within(self.requests, t, 5)
        if busy >= 35 and not self.cools(("api_flood", ""), t):
            return "api_flood", "HIGH", 0.91, "", busy
        if r.seen_tenant:
            n = self.tenants_within(r.seen_tenant, t, 30)
            if n >= 3 and not self.cools(("tenant_hopping", ""), t):
                return "tenant_hopping", "CRITICAL", 0.95, "", n
        for bot in r.bots:
            if (BOTS[bot] in ("CRITICAL", "HIGH") or busy > 3) and not self.cools(("bot_agent", bot), t):
                return "bot_agent", BOTS[bot], 0.88, bot, busy
        for rule, severity, confidence, found in (("sql_injection", "CRITICAL", 0.97, r.injections), ("path_fuzzing", "HIGH", 0.92, r.files)):
            for what in found:
                if not self.cools((rule, what), t):
                    return rule, severity, confidence, what, busy
        return None


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Requests sorted by source, segment and time through the chain; one segment of a source is remembered at a time."""
    source, state = None, _Source()
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            if (r.src_ip, r.segment) != source:
                source, state = (r.src_ip, r.segment), _Source()
            found = state.verdict(r)
            if found:
                rule, severity, confidence, what, n = found
                rows.append((f"web:{rule}", "WEB_APP_THREAT", severity, confidence, 0.0, "|".join((rule, r.src_ip or "", what or "")), r.src_ip, r.dst_ip, r.dst_port, r.protocol, r.t_us, r.flow_id, float(n)))
        yield pd.DataFrame(rows, columns=list(FIRE))


def web_alerts(requests: DataFrame) -> DataFrame:
    """Alerts of the web rules with their cooldowns, which a source's requests pass in time order.

    Where a source pauses for longer than its longest window and the cooldown, nothing is remembered, so what lies between such
    pauses goes to different tasks, each a sorted stream with some seconds of it in memory. Cooldowns are over: ``cooldown_s`` is 0.
    """
    columns = ("flow_id", "t_us", "src_ip", "dst_ip", "dst_port", "protocol", "low_path", "seen_tenant", "sign_in", "metadata", "bots", "injections", "files")
    parts = quiet_segments(web_facts(requests).select(*columns), ["src_ip"], WEB_PAUSE_US)
    rows = parts.repartition("src_ip", "segment").sortWithinPartitions("src_ip", "segment", "t_us", "flow_id")
    kinds = "detector string, category string, severity string, confidence double, cooldown_s double, key string, src_ip string, dst_ip string, dst_port int, protocol int, t_us long, flow_id long, evidence double"
    return rows.mapInPandas(_chain, kinds)


def east_west(flows: DataFrame) -> DataFrame:
    """Flows to cloud metadata services, and unusual ones to databases."""
    metadata = F.col("dst_ip").isin(*METADATA_IPS)
    database = F.col("dst_port").isin(*DATABASE_PORTS) & ~F.col("src_ip").startswith("127.") & ~F.col("src_ip").startswith("10.0.99.") & ((F.col("dst_port") == 6379) | (F.col("bytes") > 500_000))
    hit = flows.where(metadata | database)
    fired = fires(hit, "east_west", "WEB_APP_THREAT", F.when(metadata, "CRITICAL").otherwise("HIGH"), F.when(metadata, 0.99).otherwise(0.86), 15, ["src_ip", "dst_ip", "dst_port"], F.col("bytes"))
    return fired.withColumn("key", F.when(metadata, F.concat_ws("|", F.lit("metadata"), "src_ip", "dst_ip")).otherwise(F.concat_ws("|", F.lit("database"), "src_ip", F.col("dst_port").cast("string"))))


def kerberos_attacks(messages: DataFrame, seconds: float = 60) -> DataFrame:
    """Roasting attacks from flows with the Kerberos struct's fields: requests without proof, and bursts of weak tickets."""
    bare = messages.where((F.col("message") == "AS-REQ") & ~F.col("preauth"))
    roasting = fires(bare, "asrep_roasting", "IDENTITY_ATTACK", F.lit("HIGH"), F.lit(0.88), 0, ["src_ip", "dst_ip"], F.lit(1))
    service = F.when(F.size("services") > 0, F.array_join("services", "/")).otherwise("ServiceAccount")
    weak = messages.where((F.col("message") == "TGS-REQ") & F.col("rc4")).withColumn("service", service)
    weak = swept(weak, ["src_ip"], seconds, {"n": F.lit(1)}, {"n_services": "service"})
    weak = weak.where((F.col("n_services") >= 2) | F.contains("service", F.lit("MSSQLSvc")) | (F.col("n") >= 3))
    return roasting.unionByName(fires(weak, "kerberoasting", "IDENTITY_ATTACK", F.lit("CRITICAL"), F.lit(0.96), 0, ["src_ip", "dst_ip"], F.col("n")))


def rpc_attacks(messages: DataFrame) -> DataFrame:
    """Directory replication and service control from flows with an ``interface`` column."""
    hit = messages.where(F.col("interface").isin("drsuapi", "svcctl"))
    sync = F.col("interface") == "drsuapi"
    out = fires(hit, "rpc", "IDENTITY_ATTACK", F.when(sync, "CRITICAL").otherwise("HIGH"), F.when(sync, 0.98).otherwise(0.92), 0, ["src_ip", "dst_ip", "interface"], F.lit(1))
    return out.withColumn("category", F.when(F.col("severity") == "CRITICAL", "IDENTITY_ATTACK").otherwise("LATERAL_MOVEMENT"))


def domain_threats(flows: DataFrame) -> DataFrame:
    """Names made by algorithms, else names that merely look random; each name is scored once."""
    names = flows.where("domain is not null").select("domain").distinct()
    scored = names.select("domain", dga_score(F.col("domain")).alias("d"), entropy_verdict(F.col("domain")).alias("e")).where("d.is_dga or e.candidate")
    hit = flows.join(scored, "domain")
    dga = F.col("d.is_dga")
    severity = F.when(dga & (F.col("d.score") >= 0.85), "CRITICAL").otherwise("HIGH")
    confidence = F.when(dga, F.col("d.score")).otherwise(F.least(F.lit(0.99), 0.85 + F.greatest(F.lit(0.0), F.col("e.entropy") - 3.5) * 0.1))
    out = fires(hit, "domain", "DGA_DOMAIN", severity, confidence, 0, ["domain"], F.when(dga, 1).otherwise(0))
    return out.withColumn("category", F.when(F.col("evidence") == 1, "DGA_DOMAIN").otherwise("DNS_TUNNEL"))


def fast_flux(answers: DataFrame, seconds: float = 3600) -> DataFrame:
    """Domains from ``answers(domain, ips, ttl, t_us)`` with many addresses, networks and short lives in the window."""
    rows = answers.select(cleaned(F.col("domain")).alias("domain"), "ttl", "t_us", F.explode("ips").alias("ip")).withColumn("net", F.when(F.size(F.split("ip", r"\.")) == 4, F.substring_index("ip", ".", 3)))
    seen = swept(rows, ["domain"], seconds, {"n": F.lit(1), "sum_ttl": F.col("ttl")}, {"n_ips": "ip", "n_nets": "net"}).withColumn("mean_ttl", F.col("sum_ttl") / F.col("n"))
    return seen.where("n_ips >= 4 and mean_ttl <= 300 and n_nets >= 3").select("domain", "t_us", "n_ips", "n_nets", "mean_ttl").distinct()


def packet_lengths(packets: DataFrame, most: int = 32) -> DataFrame:
    """One row per conversation of ``packets``: its flow columns as the client's first packet has them, and ``lengths``.

    ``lengths`` are the first ``most`` packets' bytes in time order, the server's as negative numbers. ``most`` is how many packets
    the profile is made of: later ones say nothing in it.
    """
    low, high = canonical_pair(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    ends = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    keyed = packets.withColumns({"low": low, "high": high, "is_low": ends == low, "opener": opener()})
    order = Window.partitionBy("low", "high", "protocol").orderBy("t_us", "flow_id")
    early = keyed.withColumns({"nth": F.row_number().over(order), "client": F.first("opener").over(order)}).where(F.col("nth") <= most)
    sent = F.col("client") == F.when(F.col("is_low"), F.col("low")).otherwise(F.col("high"))
    signed = F.when(sent, F.col("bytes")).otherwise(-F.col("bytes"))
    first = F.struct("nth", "flow_id", "t_us", F.col("client.ip").alias("src_ip"), F.col("client.port").alias("src_port"), F.when(F.col("client") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("server"), "ja4")
    listed = early.groupBy("low", "high", "protocol").agg(F.min(first).alias("first"), F.array_sort(F.collect_list(F.struct("nth", signed.alias("bytes")))).alias("nths"))
    return listed.select(
        "first.flow_id", "first.t_us", "first.src_ip", "first.src_port", F.col("first.server.ip").alias("dst_ip"), F.col("first.server.port").alias("dst_port"), "protocol", "first.ja4",
        F.transform("nths", lambda p: p["bytes"]).alias("lengths"),
    )


def splt_beacons(profiles: DataFrame, benign: tuple[str, ...] = BENIGN_JA4) -> DataFrame:
    """Fired rows of encrypted conversations whose client sends few, small and alike packets, unless its JA4 is a common client's."""
    tls = (F.col("protocol") == 6) & F.col("dst_port").isin(*TLS_PORTS)
    common = F.coalesce(F.split_part("ja4", F.lit("_"), F.lit(1)).isin(*benign), F.lit(False))
    seen = profiles.where(tls & ~common & wire.splt_beacon(F.col("lengths")))
    return fires(seen, "splt", "C2_BEACONING", F.lit("HIGH"), F.lit(0.89), 0, ["src_ip", "dst_ip", "dst_port"], wire.splt_entropy(F.col("lengths")))
