import struct

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import wire
from flowquarry.operators import detect, sessions_l7
from flowquarry.sources import feeds, messages, netflow
from flowquarry.streaming import flows as streaming

T0 = 1_700_000_000


def v5(n, secs=T0, uptime=10_000):
    head = struct.pack("!HHIIIIBBH", 5, n, uptime, secs, 0, 1, 0, 0, 0)
    rec = b"".join(struct.pack("!4s4s4sHHIIIIHHBBBBHHBBH", bytes([10, 0, 0, i]), bytes([8, 8, 8, 8]), bytes(4), 1, 2, 5 + i, 500 + i, 1000, 9000, 40000 + i, 53, 0, 24, 17, 0, 0, 0, 24, 24, 0) for i in range(n))
    return head + rec


def test_netflow_v5(spark):
    whole, cut, other = v5(3), v5(3)[:-10], b"\x00\x07" + bytes(40)
    rows = netflow.decode_v5(spark.createDataFrame([("a", whole), ("b", cut), ("c", other), ("d", b"\x00"), ("e", None)], "exporter string, data binary")).orderBy("exporter", "src_port").collect()
    assert [(r.exporter, r.src_ip) for r in rows] == [("a", "10.0.0.0"), ("a", "10.0.0.1"), ("a", "10.0.0.2"), ("b", "10.0.0.0"), ("b", "10.0.0.1")]
    assert (rows[1].packets, rows[1].bytes, rows[1].dst_port, rows[1].protocol, rows[1].tcp_flags) == (6, 501, 53, 17, 24)
    assert rows[0].event_us == T0 * 1_000_000 - 1_000_000


FIELDS = ((8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (2, 4), (1, 8))


def record(i):
    return bytes([10, 0, 0, i]) + bytes([1, 2, 3, 4]) + struct.pack("!HHBIQ", 1000 + i, 443, 6, 7, 900 + i)


def templated(version, parts, seq=1):
    head = struct.pack("!HHIIII", 9, len(parts), 1, T0, seq, 77) if version == 9 else struct.pack("!HHIII", 10, 0, T0, seq, 77)
    return head + b"".join(struct.pack("!HH", i, len(b) + 4) + b for i, b in parts)


@pytest.mark.parametrize("version", [9, 10])
def test_templates(spark, version):
    fields = b"".join(struct.pack("!HH", *f) for f in FIELDS)
    template = (0 if version == 9 else 2, struct.pack("!HH", 256, len(FIELDS)) + fields)
    data = (256, record(1) + record(2) + b"\x00")
    packets = [("x", templated(version, [data], 1)), ("x", templated(version, [template], 2)), ("y", templated(version, [data], 3))]
    rows = netflow.decode(spark.createDataFrame(packets, "exporter string, data binary")).orderBy("src_ip").collect()
    assert [(r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, r.packets, r.bytes, r.flow_version) for r in rows] == [("10.0.0.1", "1.2.3.4", 1001, 443, 6, 7, 901, version), ("10.0.0.2", "1.2.3.4", 1002, 443, 6, 7, 902, version)]


def test_template_defaults_and_v6(spark):
    fields = struct.pack("!HHHH", 27, 16, 11, 2)
    packet = templated(9, [(0, struct.pack("!HH", 300, 2) + fields), (300, bytes(range(16)) + struct.pack("!H", 80))])
    r = netflow.decode(spark.createDataFrame([("x", packet)], "exporter string, data binary")).first()
    assert (r.src_ip, r.dst_ip, r.packets, r.protocol, r.bytes, r.dst_port) == ("0001:0203:0405:0607:0809:0a0b:0c0d:0e0f", "0.0.0.0", 1, 6, 0, 80)


def frame(payload, vlan=False):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28 + len(payload), 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    udp = struct.pack("!HHHH", 5555, 2055, 8 + len(payload), 0)
    return bytes(12) + (b"\x81\x00\x00\x01" if vlan else b"") + b"\x08\x00" + ip + udp + payload


def test_pcap(spark, tmp_path):
    for name, order in (("be.pcap", ">"), ("le.pcap", "<")):
        frames = [frame(b"one"), frame(b"two", True), bytes(60)]
        body = b"".join(struct.pack(order + "IIII", T0, n, len(f), len(f)) + f for n, f in enumerate(frames))
        (tmp_path / name).write_bytes(struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body)
    found = feeds.read_pcap(spark, str(tmp_path))
    assert found.count() == 6
    rows = feeds.udp_payloads(found, 2055).collect()
    assert sorted(bytes(r.data) for r in rows) == [b"one", b"one", b"two", b"two"] and rows[0].src_ip == "10.0.0.1"
    assert feeds.udp_payloads(found, 1).count() == 0


def test_feeds(spark):
    lines = spark.createDataFrame([("# list",), ("2024-01-01,45.33.32.156,443,online,Emotet",), ("no address",)], "value string")
    assert [tuple(r) for r in feeds.feodo(lines).collect()] == [("45.33.32.156", "Emotet")]
    bundle = '{"type":"bundle","objects":[{"type":"indicator","name":"n","pattern":"[ipv4-addr:value = \'1.2.3.4\']"},{"type":"malware","name":"m"}]}'
    assert [tuple(r) for r in feeds.stix(spark.createDataFrame([(bundle,), ("broken",)], "value string")).collect()] == [("1.2.3.4", "n")]
    r = feeds.telemetry(spark.createDataFrame([('{"src_ip":"1.1.1.1","bytes":7}',)], "value string")).first()
    assert (r.src_ip, r.bytes, r.packets, r.src_port, r.tcp_flags) == ("1.1.1.1", 7, 10, 45000, 24)


def hello(sni=b"a.example"):
    ext = lambda k, b: struct.pack("!HH", k, len(b)) + b
    exts = ext(0x0A0A, b"") + ext(0, struct.pack("!HBH", len(sni) + 3, 0, len(sni)) + sni) + ext(16, b"\x00\x03\x02h2") + ext(10, b"\x00\x02\x00\x1d") + ext(13, b"\x00\x02\x04\x03") + ext(43, b"\x02\x03\x04")
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x04\x13\x01\x0a\x0a" + b"\x01\x00" + struct.pack("!H", len(exts)) + exts
    return b"\x16\x03\x01" + struct.pack("!H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def dns(name=b"\x03www\x04evil\x03com\x00", ips=((1, 2, 3, 4), (5, 6, 7, 8))):
    answers = b"".join(b"\xc0\x0c" + struct.pack("!HHIH", 1, 1, 60 + n, 4) + bytes(ip) for n, ip in enumerate(ips))
    return struct.pack("!HHHHHH", 7, 0x8180, 1, len(ips), 0, 0) + name + struct.pack("!HH", 1, 1) + answers


def test_messages(spark):
    df = spark.createDataFrame([(hello(), dns()), (b"junk", struct.pack("!H", len(dns())) + dns()), (None, b"\xc0" * 20)], "h binary, d binary")
    rows = df.select(messages.tls_hello(F.col("h")).alias("h"), messages.dns_message(F.col("d")).alias("d")).collect()
    assert (rows[0].h.sni, rows[0].h.alpn, rows[0].h.version, rows[0].h.ciphers) == ("a.example", "h2", 772, [0x1301, 0x0A0A]) and rows[1].h.version is None
    assert (rows[0].d.domain, rows[0].d.ips, rows[0].d.ttl) == ("www.evil.com", ["1.2.3.4", "5.6.7.8"], 60) and rows[1].d.domain == "www.evil.com" and rows[2].d.domain is None
    assert rows[0].d.response


def test_payload_expressions(spark):
    import uuid

    asreq = b"\x6a\x10" + b"\x02\x01\x17" + b"MSSQLSvc" + bytes(5)
    bind = bytes([5, 0, 11]) + bytes(13) + bytes(12) + uuid.UUID(wire.RPC["drsuapi"][0]).bytes_le
    get = b"POST /login?x=1 HTTP/1.1\r\nHost: h.example\r\nUser-Agent: sqlmap/1\r\nX-Tenant: t1\r\n\r\nbody"
    df = spark.createDataFrame([(asreq, bind, get), (struct.pack("!I", len(asreq)) + asreq, b"x", b"nothing"), (None, None, None)], "k binary, r binary, h binary")
    rows = df.select(wire.kerberos(F.col("k")).alias("k"), wire.rpc_interface(F.col("r")).alias("r"), wire.http_request(F.col("h")).alias("h")).collect()
    assert (rows[0].k.message, rows[0].k.preauth, rows[0].k.rc4, rows[0].k.services) == ("AS-REQ", False, True, ["MSSQLSvc"]) and rows[1].k.message == "AS-REQ"
    assert rows[0].r == "drsuapi" and rows[1].r is None and rows[2].k is None and rows[1].h is None
    h = rows[0].h
    assert (h.method, h.path, h.host, h.user_agent, h.tenant, h.body) == ("POST", "/login", "h.example", "sqlmap/1", "t1", "body")


def requests(spark, rows):
    kind = "flow_id long, t_us long, src_ip string, dst_ip string, dst_port int, protocol int, method string, path string, uri string, host string, user_agent string, tenant string, body string"
    return spark.createDataFrame([(n, T0 * 1_000_000 + int(t * 1e6), s, d, 80, 6, m, p, u, "h", a, x, b) for n, (t, s, d, m, p, u, a, x, b) in enumerate(rows)], kind)


def test_web_rules(spark):
    rows = [(i * 0.5, "1.1.1.1", "9.9.9.9", "POST", "/login", "/login", "x", None, "") for i in range(10)]
    rows += [(i, "2.2.2.2", "9.9.9.9", "GET", f"/orgs/o{i}/a", f"/orgs/o{i}/a", "x", None, "") for i in range(3)]
    rows += [(0, "3.3.3.3", "169.254.169.254", "GET", "/", "/", "x", None, ""), (0, "4.4.4.4", "9.9.9.9", "GET", "/a", "/a?q=%2527%20or%201=1", "x", None, ""), (0, "5.5.5.5", "9.9.9.9", "GET", "/.env", "/.env", "x", None, "")]
    rows += [(0, "6.6.6.6", "9.9.9.9", "GET", "/b", "/b", "sqlmap", None, ""), (0, "7.7.7.7", "9.9.9.9", "GET", "/b", "/b%zz+1", "curl/8", None, None)]
    rows += [(i * 0.1, "8.8.8.8", "9.9.9.9", "GET", "/c", "/c", "x", None, "") for i in range(36)]
    got = sorted((a.detector, a.src_ip) for a in detect.with_cooldown(sessions_l7.web_threats(requests(spark, rows))).collect())
    assert got == [("web:api_flood", "8.8.8.8"), ("web:bot_agent", "6.6.6.6"), ("web:credential_stuffing", "1.1.1.1"), ("web:path_fuzzing", "5.5.5.5"), ("web:sql_injection", "4.4.4.4"), ("web:ssrf_metadata", "3.3.3.3"), ("web:tenant_hopping", "2.2.2.2")]


def test_streaming_scan_equals_batch(spark, tmp_path):
    rows = feeds.synthetic(spark, "port_scan", 400).unionByName(feeds.synthetic(spark, "normal", 100))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    streaming.to_sink(streaming.port_scan(stream), lambda df, _: seen.extend((r.src_ip, r.t_us, r.severity) for r in df.collect()), str(tmp_path / "c1")).awaitTermination(120)
    want = [(r.src_ip, r.t_us, r.severity) for r in detect.with_cooldown(detect.port_scan(rows)).collect()]
    assert sorted(seen) == sorted(want) and want


def test_streaming_rollup(spark, tmp_path):
    rows = feeds.synthetic(spark, "normal", 3000)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = streaming.minute_rollup(stream, "protocol", late="0 seconds")
    streaming.to_sink(query, lambda df, _: seen.extend((r.minute, r.flows) for r in df.collect()), str(tmp_path / "c2")).awaitTermination(120)
    seen.sort()
    assert seen and all(n == 300 for _, n in seen[1:-1])


def test_plugins(spark):
    flows = feeds.synthetic(spark, "syn_flood", 100)
    plugins = streaming.Plugins()
    plugins.add("flood", detect.syn_flood)
    plugins.add("broken", lambda f: f.select("nothing"))
    assert plugins.run(flows).count() > 0 and set(plugins.errors) == {"broken"}
