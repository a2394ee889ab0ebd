import base64
import glob
import gzip
import hashlib
import random
import zlib

import pytest

from tidewatch.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, first string"


def pages(n=120, seed=2):
    rng = random.Random(seed)
    bodies = ["", None, "é" * 50, "<p>x</p>", "a" * 3000, "\r\n\r\nWARC/1.1\r\n\r\n"] + ["".join(rng.choices("ab<>\n é", k=rng.randrange(900))) for _ in range(40)]
    return [(i * 7 % 1000 - 20, rng.choice([None, "http://x.org/a b\r\nWARC-Type: x", "http://y.org/é"]), rng.choice(bodies), "d", "f") for i in range(n)]


def model(rows, least):
    best = {}
    for i, _, body, *_ in rows:
        best[body or ""] = max(best.get(body or "", i), i)
    found = []
    for i, _, body, *_ in rows:
        data = (body or "").encode()
        revisit = len(data) >= least and best[body or ""] != i
        found.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best[body or ""] if revisit else None))
    return sorted(found)


@pytest.mark.parametrize("least, segment", [(0, 8 << 20), (10, 64), (10_000, 100)])
def test_round_trip(spark, tmp_path, least, segment):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/w", min_bytes=least, segment_bytes=segment)
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    want = model(rows, least)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    bodies = {i: (body or "").encode() for i, _, body, *_ in rows}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == bodies[r.page_id] for r in got)
    assert {r.url for r in got} == {None, "http://x.org/a%20b%0D%0AWARC-Type:%20x", "http://y.org/é"}
    lean = warc.read_archives(spark, f"{tmp_path}/w", payloads=False)
    assert "payload" not in lean.columns and lean.count() == len(rows)


def test_files_are_plain_gzip_with_a_member_per_record(spark, tmp_path):
    rows = [(i, "u", f"body {i} " * 20, "", "") for i in range(30)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/w")
    members = 0
    for name in glob.glob(f"{tmp_path}/w/part-*"):
        data = open(name, "rb").read()
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == sum(1 for _ in warc.members_of(data))
        for piece in (1, 7, 1 << 20):
            members += sum(1 for _ in warc.members_of(data, piece))
    assert members == 3 * 30


def test_archives_of_one_task_are_rolled_by_bytes(spark, tmp_path):
    """A task that writes much makes many archives, each bounded in bytes; no page is spread over two."""
    rng = random.Random(4)
    rows = [(i, "u", "".join(rng.choices("abcdefghij", k=rng.choice([20, 900, 4000]))), "", "") for i in range(900)]
    rows += [(i, "u", rows[0][2], "", "") for i in range(900, 1200)]  # a hot payload
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    warc.write_archives(table, f"{tmp_path}/w", segment_bytes=1000, row_bytes=3000)
    sizes = [len(open(name, "rb").read()) for name in glob.glob(f"{tmp_path}/w/part-*")]
    longest = max(sum(map(len, warc.records(i, "u", body.encode(), None, 1000))) for i, _, body, *_ in rows)
    assert len(sizes) > 20 and max(sizes) <= warc.ROWS_PER_ARCHIVE * (3000 + longest)
    for name in glob.glob(f"{tmp_path}/w/part-*"):
        assert all(r[2] is not None or r[5] == "revisit" for r in warc.read_records(open(name, "rb").read()))
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == model(rows, 0)


def test_damage_is_found():
    good = b"".join(warc.records(5, "u", b"payload" * 50, None, 100))
    assert [r[3] for r in warc.read_records(good)] == [350]
    parts = list(warc.records(5, "u", b"payload" * 50, None, 100))
    plain = zlib.decompress(parts[0], 31)
    pack = lambda data: (p := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(data) + p.flush()
    for bad in (
        good[:-3], b"".join(parts[:-1]), parts[0] + parts[0], parts[1], pack(plain.replace(b"payload", b"paYload", 1)),
        pack(plain.replace(b"Content-Length: ", b"Content-Length: 1", 1)), pack(plain[:-1]),
    ):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(bad))


def test_repeats_nulls_and_nothing(spark, tmp_path):
    rows = [(3, "u", "x", "", ""), (3, "u", "x", "", ""), (1, "u", "x", "", ""), (None, "u", "x", "", ""), (None, None, None, "", ""), (9, "u", None, "", ""), (None, "u", "alone", "", "")]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/w")
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    found = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    assert found == sorted([(3, "response", None)] * 2 + [(1, "revisit", 3), (None, "revisit", 3), (None, "revisit", 9), (9, "response", None), (None, "response", None)], key=repr)
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").collect() == []
