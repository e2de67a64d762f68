import random
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from flowquarry.functions.wire import RPC
from flowquarry.operators import blocks, correlate, detect, engine, ml, sessions_l7
from flowquarry.sources.flows import flow_view
from tests.test_analytics import T0, flows


def with_payload(spark, rows):
    """Flows of (seconds, source, target, port, protocol, flags, packets, bytes, payload)."""
    plain = flows(spark, [(t, s, d, 40000, p, proto, flags, n, b) for t, s, d, p, proto, flags, n, b, _ in rows])
    bodies = spark.createDataFrame([(i, bytearray(r[-1]) if r[-1] is not None else None) for i, r in enumerate(rows)], "at long, payload binary")
    ordered = plain.withColumn("at", F.col("flow_id") - plain.agg(F.min("flow_id")).first()[0])
    return ordered.join(bodies, "at").drop("at")


def test_messages_are_read_from_payloads(spark):
    guid = uuid.UUID(RPC["drsuapi"][0]).bytes_le
    rows = [
        (0, "10.0.0.1", "10.0.0.2", 80, 6, 24, 5, 900, b"GET /x HTTP/1.1\r\nHost: a\r\nUser-Agent: sqlmap/1.7\r\n\r\n"),
        (1, "10.0.0.1", "10.0.0.3", 445, 6, 24, 5, 900, b"\x05\x00\x0b" + bytes(29) + guid + bytes(8)),
        (2, "10.0.0.1", "10.0.0.4", 88, 6, 24, 5, 900, b"\x6a" + bytes(12)),
        (3, "10.0.0.1", "198.51.100.77", 9999, 6, 24, 5, 900, None),
        (4, "198.51.100.200", "10.0.0.1", 9999, 6, 24, 5, 900, None),
        (5, "10.0.0.5", "10.0.0.6", 4000, 6, 24, 5, 900, b"nothing known"),
    ]
    found = engine.alerts(with_payload(spark, rows)).collect()
    seen = {(r.detector, r.t_us - T0, r.category, r.severity, r.rule_order) for r in found if r.detector != "campaign"}
    assert ("web:bot_agent", 0, "WEB_APP_THREAT", "CRITICAL", 11) in seen
    assert ("rpc", 1_000_000, "IDENTITY_ATTACK", "CRITICAL", 11) in seen
    assert ("asrep_roasting", 2_000_000, "IDENTITY_ATTACK", "HIGH", 11) in seen
    assert ("indicator", 3_000_000, "MALICIOUS_C2", "CRITICAL", 1) in seen
    assert ("indicator_filter", 4_000_000, "MALICIOUS_C2", "HIGH", 1) in seen
    assert not [s for s in seen if s[1] == 5_000_000]
    assert len({r.alert_id for r in found}) == len(found)
    assert all(r.technique_id and r.requirements for r in found)
    assert engine.fired_rows(with_payload(spark, rows)).count() == len(seen)


def test_deviations_only_where_nothing_fired(spark):
    rows = [(i, f"10.0.0.{i % 9}", "10.0.1.1", 4000 + i, 6, 24, 5, 900 + i % 7, None) for i in range(80)]
    rows += [(100, "10.0.0.50", "10.0.1.1", 4000, 6, 24, 5, 900_000, None), (101, "10.0.0.51", "198.51.100.77", 4000, 6, 24, 5, 900_000, None)]
    got = {(r.detector, r.src_ip) for r in engine.alerts(with_payload(spark, rows)).collect() if r.detector != "campaign"}
    assert got == {("deviation", "10.0.0.50"), ("indicator", "10.0.0.51")}


def test_plugins_come_last(spark):
    rows = [(0, "10.0.0.1", "10.0.0.2", 4000, 6, 24, 5, 900, None)]

    def every(f):
        return sessions_l7.fires(f, "mine", "ANOMALY_ML", F.lit("LOW"), F.lit(0.5), 0, ["src_ip"], F.lit(1))

    [r] = engine.alerts(with_payload(spark, rows), plugins=[every]).collect()
    assert (r.detector, r.rule_order) == ("plugin:mine", 13)


def brute_chain(requests):
    """The web rules one request after the other, from lists of all that came before."""
    out, fired, log = [], {}, {"auth": [], "all": [], "tenant": []}
    for r in sorted(requests, key=lambda r: (r["t_us"], r["flow_id"])):
        t, src = r["t_us"], r["src_ip"]

        def recent(name, seconds, t=t, src=src):
            return [x for at, s, x in log[name] if s == src and t - at <= seconds * 1_000_000]

        def free(*key, t=t, src=src):
            if t - fired.get((src, *key), t - 15_000_000) < 15_000_000:
                return False
            fired[src, *key] = t
            return True

        def verdict(r=r, t=t, src=src, recent=recent, free=free):
            if r["dst_ip"] == "169.254.169.254" and free("ssrf_metadata", r["dst_ip"]):
                return "ssrf_metadata"
            if r["method"] == "POST" and r["path"] == "/login":
                log["auth"].append((t, src, 0))
                if len(recent("auth", 10)) >= 8 and free("credential_stuffing", r["path"]):
                    return "credential_stuffing"
            log["all"].append((t, src, 0))
            if len(recent("all", 5)) >= 35 and free("api_flood"):
                return "api_flood"
            if r["tenant"]:
                log["tenant"].append((t, src, r["tenant"]))
                if len(set(recent("tenant", 30))) >= 3 and free("tenant_hopping"):
                    return "tenant_hopping"
            agent = r["user_agent"]
            for tool in ("sqlmap", "curl/"):
                if tool in agent and (tool == "sqlmap" or len(recent("all", 5)) > 3) and free("bot_agent", tool):
                    return "bot_agent"
            for pattern in ("union select", "drop table"):
                if pattern in r["uri"].lower() and free("sql_injection", pattern):
                    return "sql_injection"
            if "/.env" in r["path"] and free("path_fuzzing", "/.env"):
                return "path_fuzzing"
            return None

        rule = verdict()
        if rule:
            out.append((r["flow_id"], f"web:{rule}"))
    return sorted(out)


def test_web_chain_falls_through_rules_that_cool_down(spark):
    rng = random.Random(3)
    rows, t = [], T0
    for i in range(1200):
        t += rng.choice([0, 20_000, 30_000, 60_000]) if i < 600 else rng.choice([100_000, 400_000, 3_000_000])
        path = rng.choice(["/login", "/.env", "/a", "/b"])
        rows.append(
            {
                "flow_id": i, "t_us": t, "src_ip": f"10.0.0.{rng.randrange(3)}", "dst_ip": rng.choice(["10.1.1.1"] * 9 + ["169.254.169.254"]), "dst_port": 80, "protocol": 6,
                "method": rng.choice(["GET", "POST"]), "path": path, "uri": path + rng.choice(["", "", "?q=UNION SELECT", "?q=drop table x"]), "host": "shop",
                "user_agent": rng.choice(["Mozilla", "sqlmap/1", "curl/8"]), "tenant": rng.choice([None, None, "a", "b", "c"]), "body": "",
            }
        )
    kinds = "flow_id long, t_us long, src_ip string, dst_ip string, dst_port int, protocol int, method string, path string, uri string, host string, user_agent string, tenant string, body string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], kinds)
    found = sorted((r.flow_id, r.detector) for r in sessions_l7.web_alerts(df).collect())
    want = brute_chain(rows)
    assert found == want
    assert len({d for _, d in want}) == 7


CASE_NAMES = ["tenant_id", "alert_id", "t_us", "src_ip", "dst_ip", "category", "severity"]


def brute_cases(rows):
    """Cases one alert at a time over each tenant's whole past; an address keeps the name of its last case for ever."""
    cases, case_of, out = {}, {}, []
    for tenant, alert, t, src, dst, category, severity in sorted(rows, key=lambda r: (r[2], r[1])):
        name = case_of.get((tenant, src)) or case_of.get((tenant, dst))
        if name is None or t - cases[name]["t"] > 1_800_000_000:
            name = f"{tenant}/{alert}"
            cases[name] = {"p": correlate.PRIOR, "stages": set(), "last": None, "done": False, "n": 0}
        case = cases[name]
        for ip in (src, dst):
            if ip and ip != "0.0.0.0":
                case_of[tenant, ip] = name
        stage = correlate.CASE_STAGES.get(category, "RECONNAISSANCE")
        case["p"] = correlate.update(case["p"], severity, case["last"], stage)
        case["stages"].add(stage)
        case["last"], case["t"], case["n"] = stage, t, case["n"] + 1
        escalates = not case["done"] and len(case["stages"]) >= 2 and case["p"] >= correlate.ESCALATE_AT
        case["done"] |= escalates
        out.append((tenant, alert, name, case["n"], len(case["stages"]), case["p"], escalates))
    return sorted(out, key=str)


def case_rows(df):
    found = correlate.cases(df).collect()
    return sorted(((r.tenant_id, r.alert_id, r.case_id, r.n_alerts, r.n_stages, r.probability, r.escalates) for r in found), key=str)


@pytest.mark.parametrize(("seed", "hosts", "hours"), [(1, 60, 40), (2, 12, 30), (3, 200, 6)])
def test_cases_equal_one_alert_at_a_time(spark, seed, hosts, hours):
    """Groups that merge late, hosts that come back to a case others kept open, ends that are no addresses, repeated times."""
    rng = random.Random(seed)
    ip = lambda: rng.choice([f"h{rng.randrange(hosts)}"] * 12 + ["0.0.0.0", "", None])
    categories = [*correlate.CASE_STAGES, "OTHER"]
    rows = [(rng.choice(["a", "b"]), f"x{i:04d}", rng.randrange(hours * 12) * 300_000_000, ip(), ip(), rng.choice(categories), rng.choice(["LOW", "MEDIUM", "HIGH", "CRITICAL"])) for i in range(400)]
    df = spark.createDataFrame(rows, "tenant_id string, alert_id string, t_us long, src_ip string, dst_ip string, category string, severity string")
    assert case_rows(df) == brute_cases(rows)


def test_a_case_kept_open_by_others_takes_a_host_back(spark):
    at = lambda m: m * 60_000_000
    rows = [("t", "a", at(0), "A", "B", "PORT_SCAN", "LOW"), ("t", "b", at(20), "B", "C", "PORT_SCAN", "LOW"), ("t", "c", at(40), "C", "D", "PORT_SCAN", "LOW"), ("t", "d", at(65), "A", "E", "EXFILTRATION", "HIGH")]
    rows += [("t", "e", at(200), "A", "F", "PORT_SCAN", "LOW"), ("t", "f", at(201), "G", "F", "PORT_SCAN", "LOW"), ("t", "g", at(202), "B", "F", "PORT_SCAN", "LOW")]
    df = spark.createDataFrame(rows, "tenant_id string, alert_id string, t_us long, src_ip string, dst_ip string, category string, severity string")
    assert case_rows(df) == brute_cases(rows)
    groups = {r.alert_id: r.group for r in correlate.case_groups(df).collect()}
    assert groups["a"] == groups["d"] != groups["e"] == groups["g"]


def test_one_tenant_is_many_groups(spark):
    rows = [("t", f"x{k}-{i}", k * 60_000_000 + i * 600_000_000, f"s{k}", f"d{k}", "PORT_SCAN", "LOW") for k in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "tenant_id string, alert_id string, t_us long, src_ip string, dst_ip string, category string, severity string")
    assert correlate.case_groups(df).select("group").distinct().count() == 40
    assert case_rows(df) == brute_cases(rows)


@pytest.mark.parametrize("length", [1_000_000, 37_000_000, 10**12])
def test_blocks_of_time_do_not_show(spark, length):
    """History, volumes, averages and segments of a key that has nine tenths of the rows, with blocks of any length."""
    rng = random.Random(6)
    rows = [(rng.randrange(4000) / 4, "10.0.0.1" if rng.random() < 0.9 else f"10.0.0.{rng.randrange(2, 6)}", f"10.0.1.{rng.randrange(3)}", 40000, 443, 6, rng.choice([2, 18, 24]), 1, 10**9 + rng.randrange(90)) for _ in range(300)]
    df = flows(spark, rows)

    def figures(length):
        past = blocks.history(df, ["src_ip"], "bytes", own=False, length_us=length)
        values = {"n": F.lit(1), "b": F.col("bytes")}
        sums = blocks.running_sums(past, ["src_ip"], values, {"first_target": F.col("dst_ip")}, length)
        cut = blocks.quiet_segments(sums, ["src_ip"], 3_000_000, length)
        means = {r.key: (r.n, round(r.mean, 4), round(r.std, 4)) for r in ml.online_means(df, "src_ip", "bytes", 0.1, length).collect()}
        return sorted((r.flow_id, r.n_before, r.mean_before and round(r.mean_before, 4), r.deviation_before and round(r.deviation_before, 4), r.n, r.b, r.first_target, r.segment) for r in cut.collect()), means

    found, means = figures(length)
    assert len(found) == len(rows)
    order = sorted(range(len(rows)), key=lambda i: (int(rows[i][0] * 1e6), i))
    for i, n_before, mean, deviation, n, b, target, segment in found:
        mine = [j for j in order if rows[j][1] == rows[i][1]]
        before = [rows[j][8] for j in mine[: mine.index(i)]]
        times = [int(rows[j][0] * 1e6) for j in mine if int(rows[j][0] * 1e6) <= int(rows[i][0] * 1e6)]
        assert segment == sum(y - x >= 3_000_000 for x, y in zip(times, times[1:], strict=False))
        assert (n_before, n, b, target) == (len(before), len(before) + 1, sum(before) + rows[i][8], rows[mine[0]][2])
        assert mean == pytest.approx(statistics.mean(before)) if before else mean is None
        assert deviation == pytest.approx(statistics.stdev(before), rel=1e-5, abs=1e-9) if len(before) > 1 else deviation is None
    for ip in {r[1] for r in rows}:
        mean, var, own = None, 1.0, [rows[j][8] for j in order if rows[j][1] == ip]
        for x in own:
            off = 0 if mean is None else x - mean
            var = 1.0 if mean is None else 0.9 * (var + 0.1 * off * off)
            mean = x if mean is None else mean + 0.1 * off
        assert means[ip] == (len(own), pytest.approx(mean), pytest.approx(max(0.001, var**0.5), rel=1e-4))


def test_slices_of_time_do_not_show(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.random() * 300, "10.0.0.1", f"10.0.1.{rng.randrange(6)}", 40000, rng.choice([22, 445, 3389]), 6, 2, 1, rng.randrange(900)) for _ in range(400)]
    df = flows(spark, rows)

    def figures(slices):
        monkeypatch.setattr(detect, "SLICE_WINDOWS", slices)
        out = detect.swept(df, ["src_ip"], 7, {"n": F.lit(1), "b": F.col("bytes")}, {"ports": "dst_port", "hosts": "dst_ip"})
        return sorted((r.flow_id, r.n, r.b, r.ports, r.hosts) for r in out.collect())

    assert figures(1) == figures(3) == figures(10_000)
    want = [(i, *(lambda seen: (len(seen), sum(x[8] for x in seen), len({x[4] for x in seen}), len({x[2] for x in seen})))([x for x in rows if 0 <= int(r[0] * 1e6) - int(x[0] * 1e6) <= 7_000_000])) for i, r in enumerate(rows)]
    assert figures(1) == want


def test_gaps_over_slices_equal_brute_force(spark):
    """Gaps that begin in one slice and end in the next, ties, bursts and pauses longer than the window."""
    import random

    rng, rows, t = random.Random(3), [], 0
    for i in range(1500):
        t += rng.choice((0, 20_000, 400_000, 1_500_000, 3_000_000, 9_000_000))
        rows.append((i, t, "a" if rng.random() < 0.8 else "b", "wide " * 9))
    df = spark.createDataFrame(rows, "flow_id long, t_us long, src_ip string, other string")
    found = {r.flow_id: tuple(r[c] for c in ("n", *detect.GAP_FIGURES)) for r in detect.swept(df, ["src_ip"], 5, {"n": F.lit(1)}, gaps=(0.05, 5)).collect()}
    assert t > 3 * detect.SLICE_WINDOWS * 5_000_000 and len(found) == len(rows)
    for i, at, key, _ in rows:
        times = sorted(u for _, u, k, _ in rows if k == key and at - 5_000_000 <= u <= at)
        gaps = [b - a for a, b in zip(times, times[1:], strict=False) if b - a > 50_000]
        assert found[i] == (len(times), len(gaps), sum(gaps), sum(g * g for g in gaps))


def test_detectors_filter_flows_above_their_projection(spark, sf):
    """Below it, each mention of a column would be a copy of its cases, in code too large to be compiled."""
    found = flow_view(spark, sf).where("bytes <= 500000 and not (dst_ip like '224.%' or dst_ip like '239.%')").select("flow_id", "dst_ip")
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert filters and not any("CASE" in line for line in filters)


def test_the_flow_view_is_worked_out_in_compiled_methods(spark, sf):
    """A stage in one method of more than 8,000 bytes would only be interpreted."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    found = flow_view(spark, sf).select("src_ip", "dst_ip", "bytes", "domain")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert found.count() == spark.read.parquet(f"{sf}/events.parquet").count()
