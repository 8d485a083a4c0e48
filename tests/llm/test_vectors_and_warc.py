"""Vectors and web archives against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import neighbours, warc

V = "vec_id long, embedding array<double>, label int, id long, part string, component int"


@pytest.fixture(scope="module")
def vectors(spark):
    r, rows = np.random.default_rng(3), []
    for c in range(6):
        center = r.normal(size=16)
        for _ in range(25):
            rows.append((center + r.normal(size=16) * [0.01, 0.05, 0.12][c % 3]) * r.uniform(0.1, 9))
    rows += list(r.normal(size=(80, 16)))
    data = [(i, v.tolist(), i % 2 if i < 100 else 0, 1, "p", 2) for i, v in enumerate(rows)]
    data += [(500, None, 0, 1, "p", 2), (501, [], 0, 1, "p", 2), (502, [0.0] * 16, 0, 1, "p", 2), (503, [None, *[1.0] * 15], 0, 1, "p", 2), (504, [float("nan"), *[1.0] * 15], 0, 1, "p", 2), (505, data[0][1], None, 1, "p", 2), (506, [1.0, 2.0], 0, 1, "p", 2), (507, data[0][1], 0, 1, "p", 2)]
    return spark.createDataFrame(data, V), data


def brute(data):
    usable = [(i, np.array(v), label) for i, v, label, *_ in data if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    linked = []
    for a, (i, v, m) in enumerate(usable):
        for j, w, k in usable[:a]:
            if m == k and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                linked.append((i, j))
    low = {i: i for i, *_ in data}
    for _ in range(40):
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    return {i: sum(i in e for e in linked) for i in low}, low


def test_near_vectors(vectors):
    df, data = vectors
    links, low = brute(data)
    found = {r.vec_id: r for r in neighbours.near_vectors(df, k=5, leaf=16).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (links[i], low[i], low[i] == i) for i in low}


def test_large_components_count_all_links(vectors, spark):
    df, data = vectors
    links, _ = brute(data)
    points = neighbours.usable(df).where("part = '0/16'")
    counted = neighbours.count_links(points.select(F.lit(1).cast("long").alias("component"), "id", "vec"), block=11)
    ids = [i for i, v, label, *_ in data if label == 0 and v and len(v) == 16 and i not in (502, 503, 504)]
    assert {r.id: r.n_links for r in counted.collect() if r.n_links} == {i: links[i] for i in ids if links[i]}


@pytest.mark.parametrize("apart", [0.0, 0.01])
def test_saturated_groups_are_linked(spark, apart):
    """Groups of more copies than a list holds, linked with each other; with ``apart`` not by the copies but by some of them."""
    r, rows = np.random.default_rng(8), list(np.random.default_rng(9).normal(size=(60, 16)))
    one, up, side = np.linalg.qr(r.normal(size=(16, 3)))[0].T
    for n, angle in ((30, 0.0), (30, 0.19 + apart), (25, 1.0)):
        center = one * np.cos(angle) + up * np.sin(angle)
        rows += [center * (1 + 1e-3 * i) + side * 1e-3 * (i % 5) for i in range(n)]
    if apart:
        rows[60 + 29], rows[90 + 29] = (one * np.cos(x) + up * np.sin(x) for x in (0.005, 0.19))
    data = [(i, v.tolist(), 0, 1, "p", 2) for i, v in enumerate(rows)]
    links, low = brute(data)
    assert low[90] == 60
    found = {r.vec_id: r for r in neighbours.near_vectors(spark.createDataFrame(data, V)).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in found.items()} == {i: (links[i], low[i], low[i] == i) for i in low}


def test_the_audit_sees_missed_links_and_fails_loudly(spark, monkeypatch):
    r = np.random.default_rng(6)
    centers = r.normal(size=(40, 16))
    points = neighbours.usable(spark.createDataFrame([(i, (centers[i % 40] + 1e-4 * r.normal(size=16)).tolist(), 0, 0, "", 0) for i in range(120)], V).select("vec_id", "embedding", "label")).cache()
    all_found = points.selectExpr("id", "2L as n_links")
    assert neighbours.audit(points, all_found, 50) == 1.0
    half = points.selectExpr("id", "if(id % 40 < 10, 2L, 0L) as n_links")  # three quarters of the vectors have lost their links
    assert abs(neighbours.audit(points, half, 100) - 0.25) < 0.05
    monkeypatch.setattr(neighbours, "audit", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="recall is 0.5"):
        neighbours.near_vectors(spark.createDataFrame([(i, [1.0, float(i)], 0, 0, "", 0) for i in range(5)], V), attempts=1)


def test_no_vectors(spark):
    assert neighbours.near_vectors(spark.createDataFrame([], V)).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, 0, "", 0)] * 2 + [(None, [1.0, 0.0], 1, 0, "", 0)], V)
    assert [(r.vec_id, r.n_links) for r in neighbours.near_vectors(twice).orderBy("vec_id").collect()] == [(None, 0), (1, 0), (1, 0)]


PAGES = "page_id long, url string, html string, path string, type string"


def test_round_trip(spark):
    big = "<p>é" + "x" * 1500
    rows = [(1, "u", big, "", ""), (2, None, big, "", ""), (3, "u\r\nInjected: 1", "small", "", ""), (4, "u", "small", "", ""), (5, "u", None, "", ""), (6, "u", "", "", ""), (9, "u", big, "", ""), (7, "u", "WARC/1.1\r\n" + "y" * 200_000, "", "")]
    found = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert len(found) == len(rows)
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if i in (1, 2) else ("response", None))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_round_trip_of_repeated_rows_and_rows_without_an_id(spark):
    big = "z" * 1200
    rows = [(3, "u", big, "", ""), (3, "u", big, "", ""), (1, "u", big, "", ""), (None, "u", big, "", ""), (None, None, None, "", "")]
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    assert found == sorted([(3, "response", None, 1200)] * 2 + [(1, "revisit", 3, 1200), (None, "response", None, 1200), (None, "response", None, 0)], key=str)


def test_only_the_files_of_finished_tasks_are_read(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    (folder / "part-00000-stale-00007.warc.gz").write_bytes(warc.member(records(1)[0]))
    found = warc.round_trip(spark.createDataFrame([(1, "u", "x", "", "")], PAGES), f"file://{folder}").collect()
    assert [r.page_id for r in found] == [1]


def records(n):
    return [warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<r{i}>"}, bytes(f"payload {i} " * 200, "ascii")) for i in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.member(r) if packed else r for r in records(8)]
    whole = b"".join(parts)
    assert [x[0] for x in warc.salvage(whole)] == ["record"] * 8
    starts = np.cumsum([0, *map(len, parts)])
    damaged = bytearray(whole)
    damaged[starts[2] + len(parts[2]) // 2] ^= 0xFF  # a byte in the third record
    for i in range(starts[5], starts[5] + 8):
        damaged[i] = 0  # the sixth record's start
    cut = bytes(damaged[: starts[7] + 20])  # the last record is cut off
    found = list(warc.salvage(cut))
    ids = [h["warc-record-id"] for kind, _, _, h, _ in found if kind == "record"]
    assert ids == ["<r0>", "<r1>", "<r3>", "<r4>", "<r6>"]
    assert [(s, e) for kind, s, e, _, _ in found if kind == "gap"] == [(starts[2], starts[3]), (starts[5], starts[6]), (starts[7], len(cut))]
    assert sum(e - s for s, e in {(s, e) for _, s, e, _, _ in found}) == len(cut)  # no byte is unaccounted for


def test_salvage_of_anything():
    r = np.random.default_rng(1)
    for _ in range(30):
        junk = r.integers(0, 256, 300).astype(np.uint8).tobytes() + b"\x1f\x8b\x08junkWARC/1.1\r\nContent-Length: 5\r\n\r\nab"
        data = junk + warc.member(records(1)[0]) + junk
        assert [x[0] for x in warc.salvage(data)] == ["gap", "record", "gap"]
    assert list(warc.salvage(b"")) == []


def test_read_reports_gaps(spark, tmp_path):
    parts = [warc.member(r) for r in records(3)]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + b"rubbish" + parts[1] + parts[2][:30])
    found = warc.read_warc(spark, str(tmp_path / "*.warc.gz")).orderBy("start").collect()
    assert [r.kind for r in found] == ["record", "gap", "record", "gap"]
    assert bytes(found[0].block) == b"payload 0 " * 200


def saved(data):
    return [h["warc-record-id"] for kind, _, _, h, _ in warc.salvage(data) if kind == "record"]


def test_digests_in_other_forms():
    import base64

    block = b"some bytes"
    for name in ("sha1", "md5", "sha256"):
        own = hashlib.new(name, block).digest()
        for value, good in ((base64.b32encode(own).decode(), True), (own.hex().upper(), True), (base64.b32encode(own[::-1]).decode(), False)):
            record = warc.record_bytes({"WARC-Record-ID": "<r>"}, block).replace(b"sha1:" + hashlib.sha1(block).hexdigest().encode(), f"{name}:{value}".encode())
            assert saved(warc.member(record)) == (["<r>"] if good else [])
    record = warc.record_bytes({"WARC-Record-ID": "<r>"}, block).replace(b"sha1:", b"crc99:")
    assert saved(record) == ["<r>"]


def test_salvage_inside_a_member():
    parts = records(5)
    damaged = bytearray(b"".join(parts))
    damaged[len(parts[0]) + len(parts[1]) + 600] ^= 1  # inside the third record's block
    data = warc.member(bytes(damaged))
    found = list(warc.salvage(data))
    assert [h["warc-record-id"] for kind, _, _, h, _ in found if kind == "record"] == ["<r0>", "<r1>", "<r3>", "<r4>"]
    start = len(parts[0]) + len(parts[1])
    assert [(s, e, h) for kind, s, e, h, _ in found if kind == "inner gap"] == [(0, len(data), {"start": str(start), "end": str(start + len(parts[2]))})]


def test_salvage_of_a_member_without_an_end():
    r = np.random.default_rng(3)
    parts = [warc.record_bytes({"WARC-Record-ID": f"<r{i}>"}, r.integers(0, 256, 3000).astype(np.uint8).tobytes()) for i in range(5)]
    data = warc.member(b"".join(parts))
    cut = data[: len(data) - 2000]
    assert saved(cut) == ["<r0>", "<r1>", "<r2>", "<r3>"]
    assert {(s, e) for _, s, e, _, _ in warc.salvage(cut)} == {(0, len(cut))}
    assert saved(cut[:-1500] + warc.member(parts[4])) == ["<r0>", "<r1>", "<r2>", "<r4>"]
    broken = bytearray(data)
    broken[-4] ^= 1  # the checksum: each record's own digest proves it
    assert saved(bytes(broken)) == [f"<r{i}>" for i in range(5)]
