"""WARC archives and nearest neighbours against brute force."""

import gzip
import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumastack.llm import ann, warc

SCHEMA = "page_id long, url string, html string, digest int, first int, n int"


def pages(spark):
    big = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (1, "http://b", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "x" * 500_000), (-9, "u", "WARC/1.0\r\n\r\n" + "y" * 200)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def test_archives(spark):
    df = pages(spark)
    data = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    want = []
    for i, b in data:
        least = min((j for j, c in data if c == b and j is not None), default=None) if len(b) >= 100 and sum(c == b for _, c in data) > 1 else None
        refers = least if least is not None and i != least else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_members_and_index(spark, tmp_path):
    df = pages(spark)
    written = warc.write_archives(warc.with_revisits(df), f"file://{tmp_path}/mono")
    made = warc.normalise(written, f"file://{tmp_path}/mono", f"file://{tmp_path}/members")
    assert made.agg(F.sum("records")).first()[0] == df.count()
    for path in (tmp_path / "members").glob("*.warc.gz"):
        data = path.read_bytes()
        assert gzip.decompress(data) == gzip.decompress((tmp_path / "mono" / path.name).read_bytes())
        for line in (tmp_path / "members" / f"{path.name}.idx").read_text().splitlines():
            e = json.loads(line)
            assert gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.0\r\nWARC-Type: " + e["type"].encode())
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(made, f"file://{tmp_path}/members", payloads=True).where("record_type = 'response'").collect()}
    assert payloads[7] == b"x" * 500_000


def test_cut_off_archive_is_an_error():
    whole = gzip.compress(warc.record(1, "u", b"z" * 5000, "d", None))
    assert len(list(warc.Inflated(io.BytesIO(whole)).records())) == 1
    assert len(list(warc.Inflated(io.BytesIO(whole + whole)).records())) == 2
    with pytest.raises(EOFError):
        list(warc.Inflated(io.BytesIO(whole[:-20])).records())
    assert warc.page_of(warc.record_id(-9)) == -9


def test_records_that_inflate_far_come_in_chunks():
    """A small archive of large records: no more than a record and a chunk is ever held."""
    big = b"z" * (3 * warc.CHUNK)
    own = warc.Inflated(io.BytesIO(gzip.compress(b"".join(warc.record(i, "u", big, "d", None) for i in range(8)))))
    most = 0
    for n, (data, fields) in enumerate(own.records()):
        assert warc.page_of(fields["warc-record-id"]) == n and data.endswith(b"z\r\n\r\n")
        most = max(most, len(own.held))
    assert n == 7 and most <= len(data) + 2 * warc.CHUNK


def test_a_second_attempt_replaces_files(tmp_path):
    import pyarrow.fs as pafs

    class Strict:
        """A file system whose move does not replace."""

        def __init__(self):
            self.own = pafs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.own, name)

        def move(self, a, b):
            if self.own.get_file_info(b).type != pafs.FileType.NotFound:
                raise OSError("the target is there")
            self.own.move(a, b)

    for data in (b"one", b"two"):
        warc.put(Strict(), f"{tmp_path}/x", lambda out, data=data: out.write(data))
    assert [f.name for f in tmp_path.iterdir()] == ["x"] and (tmp_path / "x").read_bytes() == b"two"


def plain_nearest(rows, k=5):
    fit = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for q in sorted({i for i, _ in fit if i % 50 == 0}):
        found = set()
        for a in (v for i, v in fit if i == q):
            for i, b in fit:
                if i != q and len(b) == len(a):
                    found.add((float(ann.cosine(a[None], b[None])[0]), -i))
        out += [(q, rank, -i, s) for rank, (s, i) in enumerate(sorted(found, reverse=True)[:k], 1)]
    return out


def test_nearest(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 8)).astype("float32")
    base[7] = base[150]
    base[9] = base[150] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(400, None), (450, [0.0] * 8), (401, [float("nan")] + [1.0] * 7), (402, [None] + [1.0] * 7), (None, [1.0] * 8), (500, [1.0, 2.0]), (501, [2.0, 4.1]), (50, rows[50][1]), (600, [])]
    df = spark.createDataFrame([(*x, 3, 4) for x in rows], "vec_id long, embedding array<float>, dim int, ids int").repartition(4)
    rows = [(x["vec_id"], x["embedding"]) for x in df.collect()]
    got = [tuple(x) for x in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(plain_nearest(rows))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_ids_take_no_places(spark):
    near, far = [0.9, 0.19**0.5], [0.5, 0.75**0.5]
    rows = [(50, [1.0, 0.0]), *[(7, near)] * 6, (8, far), (9, [0.3, 1.0]), (9, [0.2, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for parts in (1, 4):
        got = [tuple(x) for x in ann.nearest(df.repartition(parts), F.col("vec_id") % 50 == 0).collect()]
        assert sorted(got) == sorted(plain_nearest(rows)) and len(got) == 4
    q, s = np.array([[1.0, 0.0]]), np.array([near] * 3 + [far] + [near] * 3)
    assert {i for _, _, i in ann.tile_nearest(q, np.array([50]), s, np.array([7, 7, 7, 8, 7, 7, 7]), 2)} == {7, 8}


def test_many_components_and_extreme_ones(spark):
    """Sums beyond 24 bits, components whose squares under- or overflow, and many equal rows of one id."""
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 2048))
    base[3], base[4], base[5], base[6] = base[0] * 1e-200, base[0] * 1e200, base[50] * 1e-300, base[50] + 1e-7 * r.normal(size=2048)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[0].tolist())] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(x) for x in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(plain_nearest(rows)) and len(got) == 10
    assert {x[2] for x in got if x[0] == 0} >= {3, 4, 7} and {x[2] for x in got if x[0] == 50} >= {5, 6}


def test_code_products_are_exact():
    q, s = np.full((2, 5000), 127, np.float32), np.full((3, 5000), 127, np.float32)
    assert (ann.code_products(q, s) == 127 * 127 * 5000).all()


def test_heaps_leave_between_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "HELD", 1)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    monkeypatch.setattr(ann, "STORED_BLOCK", 16)
    r = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(500, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(x) for x in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()) == sorted(plain_nearest(rows))


def test_bounds_hold():
    r = np.random.default_rng(4)
    a, b = r.normal(size=(40, 64)), r.normal(size=(60, 64)) * 10.0 ** r.integers(-6, 6, (60, 1))
    (q, qs, qe), (s, ss, se) = ann.quantised(a), ann.quantised(b)
    near = (q @ s.T) * qs[:, None] * ss[None, :]
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert (np.abs(near - true) <= qe[:, None] + (1 + qe)[:, None] * se[None, :] + 1e-9).all()
