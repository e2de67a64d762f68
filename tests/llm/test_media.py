import hashlib
import tarfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.llm import media
from tests.llm import rows as R


def brute_payload(text):
    raw = (text or "").encode()
    out = bytearray(raw)
    while not out or len(out) % 576:
        out.append(255)
    return len(raw), bytes(out)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 100_000])
def test_round_trip(n):
    text = ("aé😀" * n)[:n]
    size, payload = brute_payload(text)
    assert media.payload_of(text) == payload
    stored = media.encode(payload)
    assert media.decode(stored) == payload
    assert media.read_header(stored[: media.HEADER_BYTES]) == (576, len(payload) // 576, 8)
    assert size == len(text.encode())


def test_the_stored_form_is_a_png():
    """Chunks by the format's own rules: signature, sizes and checksums."""
    data, at, kinds = media.encode(brute_payload("hello")[1]), 8, []
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kinds.append(data[at + 4 : at + 8])
        assert zlib.crc32(data[at + 4 : at + 8 + size]) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        at += 12 + size
    assert kinds == [b"IHDR", b"IDAT", b"IEND"]


def test_rows_equal_brute_force(spark):
    docs = R.hard_documents()
    rows = media.with_media(R.frame(spark, docs)).collect()
    contract = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert list(rows[0].asDict())[:8] == contract
    wanted = Counter()
    for i, t in docs:
        n, p = brute_payload(t)
        wanted[(i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == wanted
    for r in rows:
        assert r.digest == r.payload_sha256
        assert (r.width, r.height * 576, r.depth) == (576, r.payload_bytes, 8)
    same = {}
    for r in rows:
        values = (r.media_bytes, r.media_sha256, r.feature)
        assert same.setdefault(r.payload_sha256, values) == values


def test_shards_are_tar_files_named_by_content(spark, tmp_path):
    docs = R.frame(spark, R.hard_documents()).coalesce(1)
    catalog = media.write_shards(docs, f"file://{tmp_path}/media", shard_bytes=4096).collect()
    assert len({r.shard for r in catalog}) > 1
    for shard in {r.shard for r in catalog}:
        with tarfile.open(shard.removeprefix("file://")) as tar:
            members = {m.name: m for m in tar.getmembers()}
            assert len(members) == len(tar.getmembers())
            for r in catalog:
                if r.shard == shard:
                    m = members[f"{r.digest}.png"]
                    assert (m.offset_data, m.size) == (r.offset, r.length)
                    assert hashlib.sha256(media.decode(tar.extractfile(m).read())).hexdigest() == r.digest


def test_features_see_the_payload():
    p = brute_payload("abc" * 500)[1]
    mean, deviation, height, bits = media.feature_of(p).split(":")
    samples = np.frombuffer(p, np.uint8)
    assert (float(mean), float(deviation), int(height)) == (round(samples.mean(), 4), round(samples.std(), 4), len(p) // 576)
    size = len(p)
    means = [samples[size * k // 64 : size * (k + 1) // 64].mean() for k in range(64)]
    assert bits == f"{int(''.join('1' if m > samples.mean() else '0' for m in means), 2):016x}"


def test_header_reads_take_the_header_only(spark, monkeypatch):
    docs = R.frame(spark, [(1, "x" * 5000)])
    rows = media.write_shards(docs)
    head = rows.select(media.header_columns(F.col("shard"), F.col("offset")).alias("h")).select("h.*").collect()
    assert [tuple(r) for r in head] == [(576, 9, 8)]
    assert media.HEADER_BYTES == 33


def test_reads_are_dealt_by_bytes(spark):
    docs = [(i, R.sentence(i, 300)) for i in range(200)] + [(1000 + i, "copy " * 300) for i in range(200)]
    rows = media.write_shards(R.frame(spark, docs))
    dealt = media.in_ranges(rows, 8192)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) > 8 and max(sizes) < 200


def test_empty_table(spark):
    assert media.with_media(R.empty(spark)).count() == 0


@pytest.mark.parametrize("start", ["file://", "file:", ""])
def test_folders_with_and_without_a_scheme(spark, tmp_path, start):
    rows = media.write_shards(R.frame(spark, [(1, "x" * 5000)]), f"{start}{tmp_path}/media").collect()
    assert rows[0].shard.startswith(f"{start}{tmp_path}/media/shard-")
    assert media.decode(media._Reader().read(rows[0].shard, rows[0].offset, rows[0].length)) == brute_payload("x" * 5000)[1]
