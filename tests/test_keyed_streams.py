"""Window detectors over streams give the rows they give over tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowquarry.operators import detect
from flowquarry.sources.flows import flow_view
from flowquarry.streaming import keyed

COMPARED = ("detector", "key", "t_us", "flow_id", "severity", "confidence", "evidence")


def shuffled_files(flows, folder, files, disorder_s, seed=0, like=None):
    """Flows as files in about the order of their times, each row up to ``disorder_s`` late, and at last rows far ahead, alike to one."""
    rng = random.Random(seed)
    rows = sorted(flows.collect(), key=lambda r: r.t_us + rng.random() * disorder_s * 1e6)
    spark, schema = flows.sparkSession, flows.schema
    size = -(-len(rows) // files)
    model = rows[-1] if like is None else next(r for r in rows if r.flow_id == like)
    late = [model.asDict() | {"flow_id": -k, "t_us": rows[-1].t_us + k * 3_600_000_000, "src_ip": "192.0.2.1", "dst_ip": f"192.0.2.{k}"} for k in (2, 3)]
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[tuple(r.values())] for r in late]
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("t_us"))
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/*")


def run(stream, checkpoint):
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(600)
    return seen, [[op["numRowsTotal"] for op in p["stateOperators"]] for p in query.recentProgress]


def compared(rows):
    return Counter(tuple(r[c] for c in COMPARED) for r in rows if r["flow_id"] >= 0)


DETECTORS = {
    "port_scan": (detect.port_scan, {"ports": 3}),
    "syn_flood": (detect.syn_flood, {"count": 3}),
    "bandwidth_exfil": (detect.bandwidth_exfil, {"single": 23_000_000, "total": 60_000_000}),
    "dns_volume": (detect.dns_volume, {"size": 250, "packets": 5}),
    "beaconing": (detect.beaconing, {"samples": 3, "cv": 0.6}),
    "lateral_movement": (detect.lateral_movement, {"targets": 2}),
    "encrypted_exfil": (detect.encrypted_exfil, {}),
    "encrypted_beacon": (detect.encrypted_beacon, {}),
}


@pytest.mark.parametrize("name", DETECTORS)
def test_stream_equals_table(spark, sf, tmp_path, name):
    detector, settings = DETECTORS[name]
    flows = flow_view(spark, sf)
    expected = compared(detect.with_cooldown(detector(flows, **settings)).collect())
    assert expected
    stream = shuffled_files(flows, str(tmp_path / "in"), 4, 6, like=next(iter(expected))[3])
    seen, state = run(keyed.alerts(stream, detector, late="7 seconds", **settings), str(tmp_path / "state"))
    assert compared(seen) == expected


def test_state_goes_when_keys_are_quiet(spark, sf, tmp_path):
    stream = shuffled_files(flow_view(spark, sf), str(tmp_path / "in"), 4, 6)
    _, state = run(keyed.alerts(stream, detect.port_scan, late="7 seconds", ports=3), str(tmp_path / "state"))
    totals = [sum(p) for p in state if p]
    assert max(totals) > 4
    assert totals[-1] <= 4  # what the rows far ahead leave


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    at = 1_700_000_000_000_000
    flows = lambda ids, t: [(i, None, at + int(t * 1e6) + i, "10.0.0.1", "10.0.0.2", 4000, 1000 + i, 6, 2, 1, 60, None, None, "default") for i in ids]
    from flowquarry.sources.flows import FLOW_SCHEMA

    for n, part in enumerate([flows(range(10), 0), flows([90], 60), flows([93], 62), flows(range(10, 20), 0), flows(range(20, 36), 63), flows([91], 600), flows([92], 601)]):
        spark.createDataFrame(part, FLOW_SCHEMA).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(FLOW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen, _ = run(keyed.alerts(stream, detect.port_scan, late="5 seconds"), str(tmp_path / "state"))
    assert [r.t_us for r in seen] == [at + 63_000_032]  # the late rows made no alert; those in time did, with the two before them
