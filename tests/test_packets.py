"""Probe exports, packet-length profiles, signatures and idle conversations."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from flowquarry.functions import net
from flowquarry.operators import analytics, biflow, engine, response, sessions_l7
from flowquarry.sources.flows import flow_view
from flowquarry.streaming import keyed
from tests.test_analytics import flows
from tests.test_keyed_streams import run, shuffled_files

EXPORT = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "bytes", "tcp_flags", "first_us", "last_us", "reason")


def probe(packets, idle, every):
    """One packet at a time: open flows, exports at FIN or RST, at every so many packets and when idle."""
    table, out = {}, []
    for p in sorted(packets, key=lambda p: (p.t_us, p.flow_id)):
        key = (p.src_ip, p.dst_ip, p.src_port, p.dst_port, p.protocol)
        f = table.get(key)
        if f and p.t_us - f[4] >= idle * 1_000_000:
            out.append((*key, *f, "IDLE"))
            f = None
        if f is None:
            table[key] = (1, p.bytes, p.tcp_flags, p.t_us, p.t_us)
            continue
        f = table[key] = (f[0] + 1, f[1] + p.bytes, f[2] | p.tcp_flags, f[3], p.t_us)
        if p.tcp_flags & 5:
            out.append((*key, *f, "END"))
            del table[key]
        elif f[0] % every == 0:
            out.append((*key, *f, "COUNT"))
    return sorted(out + [(*key, *f, "IDLE") for key, f in table.items()])


def random_packets(spark, seed, n=600):
    rng = random.Random(seed)
    return flows(spark, [(rng.randrange(2400) / 4, f"10.0.0.{rng.randrange(3)}", "10.0.1.1", 40000, 443, 6, rng.choice([2, 24, 24, 24, 17, 4]), 1, rng.randrange(1500)) for _ in range(n)])


@pytest.mark.parametrize("seed", [1, 2])
def test_exports_equal_a_probe(spark, seed):
    packets = random_packets(spark, seed)
    found = sorted(tuple(r[c] for c in EXPORT) for r in analytics.packet_exports(packets, 3, 4).collect())
    assert found == probe(packets.collect(), 3, 4)
    assert {r[-1] for r in found} == {"END", "COUNT", "IDLE"}


def test_streamed_exports_equal_the_table(spark, tmp_path):
    packets = random_packets(spark, 3, 300)
    stream = shuffled_files(packets, str(tmp_path / "in"), 3, 4)
    seen, state = run(keyed.packet_exports(stream, 3, 4, late="5 seconds"), str(tmp_path / "state"))
    found = sorted(tuple(r[c] for c in EXPORT) for r in seen if r.src_ip != "192.0.2.1")
    assert found == probe(packets.collect(), 3, 4)
    assert sum(state[-1]) <= 4


def test_streamed_conversations_equal_the_table(spark, sf, tmp_path):
    view = flow_view(spark, sf).where("src_port < 20000 or dst_port < 20000").limit(400)
    view = spark.createDataFrame(view.collect(), view.schema)
    columns = ["client_ip", "client_port", "server_ip", "server_port", "sent", "received", "flows", "first_us", "last_us", "state", "ratio"]
    want = sorted(tuple(map(str, r)) for r in biflow.sessions(view, 60).select(*columns).collect())
    stream = shuffled_files(view, str(tmp_path / "in"), 3, 4)
    seen, _ = run(biflow.sessions(stream.withWatermark("ts", "5 seconds"), 60).select(*columns), str(tmp_path / "state"))
    assert sorted(tuple(map(str, r)) for r in seen if "192.0.2." not in (r.client_ip + r.server_ip)) == want


def test_idle_conversations_are_cut(spark):
    rows = [(0, "10.0.0.1", "10.0.0.2", 40000, 443, 6, 2, 1, 100), (1, "10.0.0.2", "10.0.0.1", 443, 40000, 6, 18, 1, 300), (100, "10.0.0.1", "10.0.0.2", 40000, 443, 6, 2, 1, 50)]
    whole = biflow.sessions(flows(spark, rows)).collect()
    cut = sorted(biflow.sessions(flows(spark, rows), 60).collect(), key=lambda r: r.first_us)
    assert [(r.sent, r.received) for r in whole] == [(150, 300)]
    assert [(r.sent, r.received, r.state) for r in cut] == [(100, 300, "ESTABLISHED"), (50, 0, None)]


@pytest.mark.parametrize("secret", [b"", b"short", b"k" * 64, b"k" * 65, bytes(range(200))])
def test_signatures_equal_the_standard(spark, secret):
    bodies = ["", "a", "größer", "x" * 1000, None]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    found = [r.s for r in df.select(response.hmac_sha256(F.col("body"), secret).alias("s")).collect()]
    assert found == [b if b is None else hmac.new(secret, b.encode(), hashlib.sha256).hexdigest() for b in bodies]


def test_alike_client_packets_are_a_beacon(spark):
    def talk(t, client, port, sizes):
        return [(t + k / 10, client, "198.51.100.1", port, 443, 6, 24, 1, s) if s > 0 else (t + k / 10, "198.51.100.1", client, 443, port, 6, 24, 1, -s) for k, s in enumerate(sizes)]

    rows = talk(0, "10.0.0.1", 40001, [200, -900, 205, -100, 199]) + talk(1, "10.0.0.2", 40002, [200, -900, 600, -100, 90]) + talk(2, "10.0.0.3", 40003, [200, -1, 200]) + talk(3, "10.0.0.4", 40004, [1200, -1, 1200, 1200])
    packets = flows(spark, rows).withColumn("ja4", F.when(F.col("src_ip") == "10.0.0.9", "t13d1516h2_a_b"))
    profile = {r.src_ip: (r.dst_ip, r.dst_port, r.lengths) for r in sessions_l7.packet_lengths(packets).collect()}
    assert profile["10.0.0.1"] == ("198.51.100.1", 443, [200, -900, 205, -100, 199])
    assert [r.src_ip for r in sessions_l7.splt_beacons(sessions_l7.packet_lengths(packets)).collect()] == ["10.0.0.1"]
    common = sessions_l7.packet_lengths(packets.withColumn("ja4", F.lit("t13d1516h2_a_b")))
    assert sessions_l7.splt_beacons(common).collect() == []
    fired = {r.detector for r in engine.alerts(packets, packets=packets).where("detector = 'splt'").collect()}
    assert fired == {"splt"}


def test_the_alert_view_bites(spark):
    """Every branch that reports and scores have is reached by the registered queries."""
    import __spark_entry__

    queries, sf = __spark_entry__.queries(), "/root/testdata/sf0.01"
    one = queries["a17_confusion"](spark, sf).first()
    assert min(one.tp, one.fp, one.fn, one.tn) > 0
    assert {r.level for r in queries["a13_posture_by_hour"](spark, sf).collect()} == {"EXCELLENT", "DEGRADED", "CRITICAL"}
    assert {r.label for r in queries["a15_executive_by_hour"](spark, sf).collect()} >= {"LOW", "CRITICAL"}
    scores = [r.score for r in queries["e2_score_history"](spark, sf).collect()]
    assert min(scores) < 10
    assert any(20 < s < 80 for s in scores)
    assert max(scores) == 100
    from flowquarry.operators import graph

    edges = graph.edges(flow_view(spark, sf)).count()
    assert 0 < queries["g5_topology"](spark, sf).count() < edges


def test_both_directions_go_to_one_partition(spark):
    rows = [(0, f"10.0.0.{k % 5}", f"10.0.1.{k % 7}", 40000, 443, 6, 2, 1, 1) for k in range(35)]
    there = flows(spark, rows + [(1, d, s, 443, 40000, 6, 18, 1, 1) for _, s, d, *_ in rows])
    found = [r.p for r in there.orderBy("flow_id").select(net.symmetric_partition(F.col("src_ip"), F.col("dst_ip"), 8).alias("p")).collect()]
    assert found[:35] == found[35:]
    assert set(found) <= set(range(8))
    assert len(set(found)) > 4
