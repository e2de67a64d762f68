import hashlib
import struct

from pyspark.sql import functions as F

from flowquarry.functions import wire
from flowquarry.operators import analytics, evidence, hosts, intel, response
from flowquarry.sources import feeds


def bootp(options: bytes, op: int = 2, magic: bytes = b"\x63\x82\x53\x63", mac: bytes = bytes.fromhex("aabbccddeeff"), ip=(10, 0, 7, 9)) -> bytes:
    return bytes([op, 1, len(mac), 0]) + bytes(12) + bytes(ip) + bytes(8) + mac + bytes(16 - len(mac)) + bytes(192) + magic + options


def test_dhcp(spark):
    ack = b"\x35\x01\x05"
    cases = {
        1: (bootp(ack + b"\x0c\x04host\xff\x0c\x01x"), ("aa:bb:cc:dd:ee:ff", "10.0.7.9", 5, "host")),
        2: (bootp(b"\x00\x00" + ack), ("aa:bb:cc:dd:ee:ff", "10.0.7.9", 5, None)),
        3: (bootp(b""), ("aa:bb:cc:dd:ee:ff", "10.0.7.9", None, None)),
        4: (bootp(ack + b"\x0c"), ("aa:bb:cc:dd:ee:ff", "10.0.7.9", 5, None)),
        5: (bootp(ack + b"\x0c\x09ab"), ("aa:bb:cc:dd:ee:ff", "10.0.7.9", 5, "ab")),
        6: (bootp(ack, op=3), None),
        7: (bootp(ack, magic=b"abcd"), None),
        8: (bootp(ack)[:100], None),
        9: (b"", None),
        10: (None, None),
        11: (bootp(ack + b"\x0c\x02\xff\xfe", mac=b"\x01\x02"), ("01:02", "10.0.7.9", 5, "��")),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k int, data binary")
    for r in df.select("k", wire.dhcp(F.col("data")).alias("m")).collect():
        assert (tuple(r.m) if r.m else None) == cases[r.k][1], r.k


ALERT = "alert_id string, t_us long, src_ip string, dst_ip string, dst_port int, protocol int, category string, severity string, confidence double"
ALERTS = [("A1", 1_700_000_000_250_000, "10.0.0.5", "198.51.100.7", 443, 6, "EXFILTRATION", "HIGH", 0.9), ("A2", 1_700_000_001_000_000, "10.0.0.6", "10.0.0.7", 53, 17, "DNS_TUNNEL", "LOW", 0.9)]


def test_captures_are_read_back(spark, tmp_path):
    alerts = spark.createDataFrame(ALERTS, ALERT)
    flows = spark.createDataFrame([("A1", f"10.0.0.{k}", "198.51.100.7", 40000 + k, 443, 17, 24, k) for k in range(7)], "alert_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, tcp_flags int, flow_id long")
    files = evidence.captures(evidence.frames(alerts, flows), frames_per_file=5).collect()
    assert sorted((r.alert_id, r.part, r.n_packets) for r in files) == [("A1", 0, 5), ("A1", 1, 2), ("A2", 0, 5)]
    for r in files:
        assert hashlib.sha256(r.content).hexdigest() == r.sha256
        assert struct.unpack("<IHHiIII", r.content[:24]) == (0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
        (tmp_path / f"{r.alert_id}-{r.part}.pcap").write_bytes(r.content)
    packets = feeds.udp_payloads(feeds.read_pcap(spark, f"{tmp_path}/*.pcap")).orderBy("t_us").collect()
    assert len(packets) == 12
    first = packets[0]
    assert (first.t_us, first.src_ip, first.dst_ip, first.src_port, first.dst_port) == (1_700_000_000_250_000, "10.0.0.0", "198.51.100.7", 40000, 443)
    assert bytes(first.data) == b"evidence alert:A1 flow:1"
    assert bytes(packets[-1].data) == b"evidence alert:A2 category:DNS_TUNNEL packet:5"


def test_tcp_frames(spark):
    row = evidence.frames(spark.createDataFrame(ALERTS[:1], ALERT)).where("nth = 1").first()
    frame = bytes.fromhex(row.frame)
    assert len(frame) == 14 + 40 + len("evidence alert:A1 category:EXFILTRATION packet:2")
    assert struct.unpack("!H", frame[16:18])[0] == len(frame) - 14
    assert struct.unpack("!HHIIBB", frame[34:48]) == (49153, 443, 11000, 0, 0x50, 2)


def test_policies(spark):
    rows = {r.alert_id: r for r in response.policies(spark.createDataFrame(ALERTS, ALERT), "lab").collect()}
    assert rows["A1"].target_ip == "198.51.100.7" and rows["A2"].target_ip == "10.0.0.6"
    assert "name: quarantine-a1\n  namespace: lab" in rows["A1"].quarantine
    assert "policyTypes:\n  - Ingress\n  - Egress" in rows["A2"].isolation


def test_indicators_are_edited(spark):
    kind = "ip string, family string"
    iocs, added = spark.createDataFrame([("1.1.1.1", "a"), ("2.2.2.2", "b")], kind), spark.createDataFrame([("2.2.2.2", "new"), ("3.3.3.3", "c")], kind)
    out = intel.edited(iocs, added, spark.createDataFrame([("1.1.1.1",), ("9.9.9.9",)], "ip string"))
    assert sorted(map(tuple, out.collect())) == [("2.2.2.2", "new"), ("3.3.3.3", "c")]
    assert intel.edited(iocs).count() == 2


def test_entities(spark):
    rows = [("AA-BB", "Alpha", "10.0.0.1", 1), (None, "ALPHA", "10.0.0.2", 2), ("aa:bb", None, "10.0.0.3", 3), (None, None, "10.0.0.3", 4), (None, "beta", "10.0.0.3", 5), (None, None, "10.0.0.9", 6)]
    found = {r.entity: r for r in hosts.entities(spark.createDataFrame(rows, "mac string, hostname string, ip string, t_us long")).collect()}
    assert set(found) == {"mac:aa:bb", "host:beta", "ip:10.0.0.9"}
    one = found["mac:aa:bb"]
    assert (one.ip, one.hostname, one.first_us, one.last_us, one.sightings) == ("10.0.0.3", "alpha", 1, 4, 4)


def test_federation(spark):
    kind = "cluster_id string, status string, mbps double, alerts long"
    rows = [("a", "ONLINE", 10.256, 3), ("b", "OFFLINE", 99.0, 4), ("c", "ONLINE", 1.0, 0)]
    assert tuple(analytics.federation(spark.createDataFrame(rows, kind)).first()) == (3, 2, 11.26, 7)
    assert tuple(analytics.federation(spark.createDataFrame([], kind)).first()) == (0, 0, 0.0, 0)
