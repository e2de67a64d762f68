import pytest
from pyspark.sql import functions as F

from flowquarry.functions import domains, net, wire
from flowquarry.operators import analytics, biflow, correlate, detect, engine, evaluate, graph, hosts, hunt, intel, ml, response, sessions_l7, sigma
from flowquarry.sources.flows import FLOW_SCHEMA, read_flows, with_defaults, write_flows

T0 = 1_700_000_000_000_000


def flows(spark, rows):
    """Rows of (seconds, src, dst, src_port, dst_port, protocol, flags, packets, bytes)."""
    made = [
        {"flow_id": n, "t_us": T0 + int(t * 1e6), "src_ip": s, "dst_ip": d, "src_port": sp, "dst_port": dp, "protocol": p, "tcp_flags": f, "packets": k, "bytes": b, "tenant_id": "default"}
        for n, (t, s, d, sp, dp, p, f, k, b) in enumerate(rows)
    ]
    kind = "flow_id long, t_us long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, tcp_flags int, packets long, bytes long, tenant_id string"
    return spark.createDataFrame(made, kind).withColumn("ts", F.timestamp_micros("t_us"))


def columnar(spark):
    return flows(spark, [(i, f"10.0.0.{i % 4}", "198.51.100.10", 40000, 443 if i < 40 else 80, 6, 24, 10, 1000 + 100 * i) for i in range(55)])


def test_columnar_query_and_aggregates(spark):
    f = columnar(spark)
    assert analytics.query(f, {"dst_port": 80}).count() == 15
    assert analytics.query(f, {"dst_port": 443, "src_ip": None}, ["src_ip", "nothing"]).columns == ["src_ip"]
    top = [(r.ip, r.total) for r in analytics.top_talkers(f).collect()]
    assert top == [("10.0.0.2", 53200), ("10.0.0.1", 51800), ("10.0.0.0", 50400), ("10.0.0.3", 48100)]
    assert {r.bucket: r.flows for r in analytics.timeline(f, 30).collect()} == {1699999980: 10, 1700000010: 30, 1700000040: 15}
    assert analytics.query(f.limit(0)).count() == 0


def test_hunting_language(spark):
    rows = [(0, "10.0.0.15", "10.0.0.5", 1, 445, 6, 0, 35, 75000), (1, "10.0.0.22", "198.51.100.77", 1, 8080, 6, 0, 12, 1500), (2, "10.0.0.30", "8.8.8.8", 1, 53, 17, 0, 8, 6200),
            (3, "10.0.0.40", "142.250.190.46", 1, 443, 6, 0, 12000, 15728640), (4, "10.0.0.50", "10.0.0.80", 1, 80, 6, 0, 2, 200)]
    f = flows(spark, rows)
    ids = lambda q: [r.flow_id for r in hunt.hunt(f, q).collect()]
    assert [ids(q) for q in hunt.PLAYBOOKS.values()] == [[0], [1], [2], [4], [3]]
    assert ids("NOT dst_port == 53") == [0, 1, 3, 4]
    assert ids("dst_port IN [80, 443, 8080]") == [1, 3, 4]
    assert ids("NOT nothing == 1 and src_ip contains '0.50'") == [4]
    assert ids("protocol > 6") == [] and ids("protocol > 5") == [0, 1, 2, 3, 4]
    assert ids("bytes > abc") == []
    assert [hunt.literal(x) for x in ("10K", "5M", "1G", "443", "TCP", "1.5KB")] == [10240, 5242880, 1073741824, 443, "TCP", 1536]
    for bad in ("dst_port IN [80", "(dst_port == 80", "dst_port ==", "dst_port LIKE 8", "== 5", "dst_port == 80 80"):
        with pytest.raises(ValueError):
            hunt.compile_query(bad, f.columns)


def test_sigma(spark):
    text = "title: Odd port\nid: r-1\nlevel: critical\ntags:\n  - attack.command_and_control\n  - attack.t1071\ndetection:\n  selection:\n    dst_port: 9999\n    protocol: 6\n    bytes: \"> 1000\"\n  condition: selection\n"
    rule = sigma.load_rule(text)
    assert (rule.technique, rule.tactic, rule.selection["bytes"]) == ("T1071", "Command And Control", "> 1000")
    f = flows(spark, [(0, "a", "b", 1, 80, 6, 0, 1, 5000), (1, "a", "b", 1, 9999, 6, 0, 1, 5000), (2, "a", "b", 1, 9999, 6, 0, 1, 900)])
    assert [(r.flow_id, r.severity) for r in sigma.evaluate(f, (rule,)).collect()] == [(1, "CRITICAL")]
    with pytest.raises(ValueError):
        sigma.load_rule("title: nothing")


def test_sessions(spark):
    f = flows(spark, [(0, "10.0.0.1", "1.1.1.1", 5000, 443, 6, 2, 1, 300), (1, "1.1.1.1", "10.0.0.1", 443, 5000, 6, 18, 9, 1_450_000), (0, "10.0.0.2", "1.1.1.1", 6000, 443, 6, 2, 1, 30_000_000),
                      (1, "1.1.1.1", "10.0.0.2", 443, 6000, 6, 16, 1, 50_000), (0, "10.0.0.3", "1.1.1.1", 7000, 22, 6, 2, 1, 60), (1, "10.0.0.3", "1.1.1.1", 7000, 22, 6, 4, 1, 60)])
    got = {r.client_ip: (r.state, r.ratio) for r in biflow.sessions(f).collect()}
    assert got == {"10.0.0.1": ("ESTABLISHED", 0.0), "10.0.0.2": ("ESTABLISHED", 600.0), "10.0.0.3": ("RESET", 120.0)}


def test_beaconing(spark):
    steady = [(t, "10.0.0.9", "198.51.100.99", 1, 443, 6, 24, 5, 400) for t in (0, 10.2, 20, 30.1, 40, 50.3)]
    uneven = [(t, "10.0.0.8", "198.51.100.98", 1, 443, 6, 24, 5, 400) for t in (0, 0.2, 45.2, 46.3, 126.3, 126.8)]
    bulk = [(t * 10, "10.0.0.7", "198.51.100.97", 1, 443, 6, 24, 5, 600_000) for t in range(8)]
    alerts = detect.with_cooldown(detect.beaconing(flows(spark, steady + uneven + bulk))).collect()
    assert [(a.src_ip, a.severity) for a in alerts] == [("10.0.0.9", "HIGH")] and 9.5 < alerts[0].evidence < 10.5


def test_scan_flood_and_cooldown(spark):
    scan = [(i * 0.1, "10.0.0.66", "10.0.0.5", 1, 20 + i, 6, 2, 1, 60) for i in range(40)]
    late = [(200 + i * 0.1, "10.0.0.66", "10.0.0.5", 1, 20 + i, 6, 2, 1, 60) for i in range(18)]
    flood = [(i * 0.01, f"203.0.113.{i}", "10.0.0.80", 1, 80, 6, 2, 1, 60) for i in range(65)]
    acked = [(i * 0.01, f"203.0.113.{i}", "10.0.0.81", 1, 80, 6, 16, 3, 60) for i in range(65)]
    f = flows(spark, scan + late + flood + acked)
    alerts = sorted((a.detector, a.t_us - T0, a.severity) for a in detect.with_cooldown(detect.port_scan(f).unionByName(detect.syn_flood(f))).collect())
    assert alerts == [("port_scan", 1_400_000, "MEDIUM"), ("port_scan", 201_400_000, "MEDIUM"), ("syn_flood", 290_000, "HIGH")]


def test_benign_traffic_is_quiet(spark):
    f = flows(spark, [(i * 3, f"10.0.0.{i % 40}", "142.250.190.46", 40000 + i, 443, 6, 24, 60 + i % 7, 50_000 + 37 * (i % 11)) for i in range(150)]
              + [(i * 7, f"10.0.1.{i % 30}", "8.8.8.8", 50000 + i, 53, 17, 0, 2, 160) for i in range(100)])
    assert engine.alerts(f).count() == 0


def alert_rows(spark, rows):
    kind = "alert_id string, t_us long, severity string, category string, src_ip string, dst_ip string, confidence double, tenant_id string, dst_port int, protocol int, status string, vector_id string"
    return spark.createDataFrame([(f"a{n}", T0 + t * 1_000_000, s, c, a, b, 0.9, "default", 445, 6, "NEW", None) for n, (t, s, c, a, b) in enumerate(rows)], kind)


def test_bayesian_case(spark):
    a = alert_rows(spark, [(0, "MEDIUM", "PORT_SCAN", "10.0.0.5", "10.0.0.9"), (60, "HIGH", "LATERAL_MOVEMENT", "10.0.0.5", "10.0.0.9"), (120, "CRITICAL", "IDENTITY_ATTACK", "10.0.0.5", "10.0.0.9"), (9000, "LOW", "PORT_SCAN", "10.0.0.5", "x")])
    got = [(round(r.probability, 4), r.escalates) for r in correlate.cases(a).orderBy("t_us").collect()]
    assert got[:3] == [(0.1163, False), (0.4443, False), (0.9011, True)] and len({r.case_id for r in correlate.cases(a).collect()}) == 2
    assert [r.progression for r in correlate.kill_chain(a).collect()] == ["1_RECONNAISSANCE -> 2_LATERAL_MOVEMENT"]


def test_graph(spark):
    f = flows(spark, [(0, "10.0.0.10", "10.0.0.25", 1, 445, 6, 24, 9, 900), (10, "10.0.0.25", "10.0.0.100", 1, 445, 6, 24, 9, 900)])
    a = alert_rows(spark, [(0, "HIGH", "LATERAL_MOVEMENT", "10.0.0.10", "10.0.0.25"), (10, "HIGH", "LATERAL_MOVEMENT", "10.0.0.25", "10.0.0.100")])
    e, hit = graph.marked_edges(graph.edges(f), a), graph.compromised(a)
    zero = graph.patient_zero(e, hit, spark.createDataFrame([("10.0.0.100",)], "target_ip string")).first()
    assert (zero.patient_zero, zero.hops, zero.path) == ("10.0.0.10", 2, "10.0.0.10 -> 10.0.0.25 -> 10.0.0.100")
    star = flows(spark, [(0, "10.0.0.1", f"10.0.0.{i}", 1, 445, 6, 24, 1, 1) for i in (2, 3, 4, 5)])
    roles = spark.createDataFrame([("10.0.0.2", "INFRASTRUCTURE_DC"), ("10.0.0.3", "INTERNAL_SERVER"), ("10.0.0.4", "WORKSTATION"), ("10.0.0.5", "WORKSTATION")], "ip string, role string")
    blast = graph.blast_radius(graph.edges(star), spark.createDataFrame([("10.0.0.1",)], "start_ip string"), roles, hit).first()
    assert (blast.reachable, blast.critical, blast.score, blast.level) == (4, 2, 66.7, "HIGH")


def test_names(spark):
    good = ["google.com", "microsoft.com", "api.github.com", "portal.bankofamerica.com", "cdn.cloudflare.com", "telemetry.internal.corp"]
    bad = ["vzkqpmzljwtfrq.com", "x839d012kd0291kd.net", "flqwoiruzxnvbkp.biz", "qy72bc91mq04x781290.org"]
    df = spark.createDataFrame([(d,) for d in good + bad], "domain string").select("domain", domains.dga_score(F.col("domain")).alias("d"), domains.entropy(F.col("domain")).alias("h"))
    assert {r.domain for r in df.collect() if r.d.is_dga} == set(bad)
    assert spark.range(1).select(domains.entropy(F.lit("")).alias("x"), domains.entropy(F.lit("abab")).alias("y")).first() == (0.0, 1.0)


def test_fast_flux(spark):
    rows = [("f.com", [f"198.51.{i}.1" for i in range(6)], 60, T0), ("s.com", ["1.2.3.4"], 3600, T0)]
    got = sessions_l7.fast_flux(spark.createDataFrame(rows, "domain string, ips array<string>, ttl long, t_us long")).collect()
    assert [(r.domain, r.n_ips, r.mean_ttl) for r in got] == [("f.com", 6, 60.0)]


def test_addresses(spark):
    rows = ["10.1.2.3", "172.31.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "8.8.8.8", "203.0.113.9", "999.1.1.1", "::1", None]
    df = spark.createDataFrame([(r,) for r in rows], "ip string").select(net.is_internal(F.col("ip")).alias("i"), net.is_private(F.col("ip")).alias("p"), net.ip_number(F.col("ip")).alias("n"))
    got = df.collect()
    assert [r.i for r in got] == [True, True, False, True, True, False, False, False, False, False]
    assert got[6].p and not got[5].p and got[0].n == 167838211 and got[7].n is None


def test_roles_and_scores(spark):
    f = flows(spark, [(i, f"10.0.0.{i}", "10.0.9.53", 1, 53, 17, 0, 1, 1) for i in range(9)] + [(i, f"10.0.0.{i}", "10.0.9.1", 1, p, 6, 0, 1, 1) for i in range(10) for p in (88, 389)]
              + [(i, "10.0.9.7", f"10.0.8.{i}", 1, 5985, 6, 0, 1, 1) for i in range(7)])
    got = {r.ip: r.role for r in hosts.roles(f).collect()}
    assert (got["10.0.9.53"], got["10.0.9.1"], got["10.0.9.7"], got["10.0.0.1"]) == ("INFRASTRUCTURE_DNS", "INFRASTRUCTURE_DC", "ADMIN_MANAGEMENT", "WORKSTATION")
    a = alert_rows(spark, [(0, "CRITICAL", "PORT_SCAN", "h", "x"), (3600, "LOW", "PORT_SCAN", "h", "x")])
    assert hosts.threat_scores(a, T0 + 3_600_000_000).first().score == 35.0


def test_bloom(spark):
    keys = [(f"192.0.2.{i}", 1) for i in range(1, 20)] + [("192.0.2.5", -1)]
    counters = intel.bloom_counters(spark.createDataFrame(keys, "key string, n int"), 10_000, 0.001)
    asked = spark.createDataFrame([(f"192.0.2.{i}",) for i in (4, 5, 6)], "key string")
    assert {r.key: r.contained for r in intel.bloom_contains(counters, asked, 10_000, 0.001).collect()} == {"192.0.2.4": True, "192.0.2.5": False, "192.0.2.6": True}
    assert intel.bloom_shape(10_000, 0.001)[0] < 200_000


def test_networks_first_listed_wins(spark):
    f = flows(spark, [(0, "10.0.0.1", "5.6.7.8", 1, 1, 6, 0, 1, 1), (0, "5.6.7.9", "9.9.9.9", 1, 1, 6, 0, 1, 1), (0, "1.1.1.1", "2.2.2.2", 1, 1, 6, 0, 1, 1)])
    got = intel.match_networks(f, [("5.6.0.0/16", "wide"), ("5.6.7.0/24", "narrow")]).orderBy("flow_id").collect()
    assert [(r.flow_id, r.side, r.family) for r in got] == [(0, "dst", "wide"), (1, "src", "wide")]


def test_evaluation_and_response(spark):
    rows = spark.createDataFrame([(True, True)] * 4 + [(False, True)] + [(False, False)] * 5, "is_malicious boolean, alerted boolean")
    assert evaluate.confusion(rows).first()[:4] == (4, 1, 0, 5)
    assert evaluate.confusion(rows.limit(0)).first()[4:] == (1.0, 1.0, 1.0, 0.0)
    assert response.signature(b"x", b"k").startswith("sha256=")


def test_isolation_forest(spark):
    normal = [(i, "10.0.0.1", "b", 40000 + i % 100, 443, 6, 24, 10 + i % 5, 5000 + 10 * (i % 50)) for i in range(400)]
    rows = ml.features(flows(spark, [*normal, (500, "10.0.0.1", "b", 1, 6667, 17, 0, 90_000, 90_000_000)]))
    forest = ml.fit_forest(rows, trees=50)
    got = rows.select("flow_id", ml.forest_score(F.col("features"), forest).alias("s")).orderBy(F.desc("s")).first()
    assert got.flow_id == 400 and got.s > forest.cut


def test_flow_table_round_trip(spark, tmp_path):
    f = columnar(spark).withColumns({"domain": F.lit(None).cast("string"), "ja4": F.lit(None).cast("string")}).select(*FLOW_SCHEMA.names)
    write_flows(f, str(tmp_path / "flows"))
    back = read_flows(spark, str(tmp_path / "flows"))
    assert back.where("month = 202311 and dst_port = 80").count() == 15 and back.count() == 55
    assert with_defaults(spark.createDataFrame([("a",)], "src_ip string")).first().bytes == 1500


def test_fingerprints(spark):
    hello = "struct(772 as version, 771 as legacy_version, array(4865, 2570, 4866) as ciphers, array(0, 16, 43, 10) as extensions, 'a.com' as sni, 'h2' as alpn, array(1027) as signature_algorithms, array(29) as groups, array(0) as point_formats)"
    r = spark.range(1).select(F.expr(hello).alias("h")).select(wire.ja4(F.col("h")).alias("a"), wire.ja3(F.col("h")).alias("b")).first()
    import hashlib

    b = hashlib.sha256(b"1301,1302").hexdigest()[:12]
    c = hashlib.sha256(b"000a,002b_0403").hexdigest()[:12]
    assert r.a == f"t13d0204h2_{b}_{c}"
    assert r.b == hashlib.md5(b"771,4865-4866,0-16-43-10,29,0").hexdigest()
