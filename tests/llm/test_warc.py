from __future__ import annotations

import gzip
import hashlib
import os
import random
from collections import Counter

import pytest

from rebuy.llm import warc
from rebuy.llm.common import scratch_path
from tests.llm.helpers import prose

PAGES = "page_id bigint, url string, html string, sha1 string, payload string, range_id int, decision boolean"


def pages_table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 7, True) for r in rows], PAGES)


def cases():
    rng = random.Random(5)
    long = [prose(rng, 300) for _ in range(5)]
    rows = [(i, f"http://a/{i}", t) for i, t in enumerate(long)]
    rows += [(100 + i, f"http://copy/{i % 7}", long[0]) for i in range(60)]  # a hot payload
    rows += [(30 + i, None, long[1]) for i in range(4)] + [(None, "http://n", long[2]), (None, None, long[2])]
    rows += [(40, "http://same", long[3])] * 3 + [(40, "http://other", long[3]), (41, "bad url\r\nX-Evil: 1 %20é", long[4])]
    rows += [(50, "u", None), (51, "u", ""), (52, "u", ""), (53, "u", "x" * 999), (54, "u", "x" * 999), (55, "u", "x" * 1000), (56, "u", "x" * 1000)]
    rows += [(57, "u", "é" * 500), (58, "u", "é" * 500), (60, "u", prose(rng, 30_000))]
    rng.shuffle(rows)
    return rows


def brute(rows):
    payloads = [(i, u, (t or "").encode()) for i, u, t in rows]
    low = lambda v: (v is not None, v)
    best = {}
    for i, u, p in payloads:
        if p not in best or (low(i), low(u)) > best[p]:
            best[p] = (low(i), low(u))
    out, taken = [], set()
    for i, u, p in payloads:
        mine = best[p] == (low(i), low(u)) and p not in taken
        first = len(p) < 1000 or mine
        taken |= {p} if mine else set()
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if first else "revisit", None if first else best[p][0][1]))
    return Counter(out)


def contents(path):
    return {name: open(f"{path}/data/{name}", "rb").read() for name in sorted(os.listdir(f"{path}/data"))}


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "test-warc")
    manifest = warc.write_archives(pages_table(spark, cases()), path, roll_bytes=4000)
    return path, manifest


def test_records_match_brute_force(spark, archive):
    found = warc.read_archives(spark, archive[0]).collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute(cases())
    assert len({r.record_id for r in found}) == len(found)


def test_payloads_come_back(spark, archive):
    found = warc.read_archives(spark, archive[0], with_payload=True).filter("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in found} == {(t or "").encode() for _, _, t in cases()}
    evil = [r.url for r in found if r.id == 41]
    assert evil == ["bad%20url%0D%0AX-Evil:%201%20%20é"]


def test_files_are_rolled_listed_and_plain_gzip(archive):
    path, manifest = archive
    rows, files = manifest.collect(), contents(path)
    assert sorted(r.file for r in rows) == sorted(files) and len(rows) > 3
    assert all(r.bytes == len(files[r.file]) and r.files == len(rows) for r in rows)
    assert sum(r.records for r in rows) == len(cases())
    text = gzip.decompress(b"".join(files.values()))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(cases()) + len(files)
    assert not [d for d in os.listdir(path) if d.startswith("staging")]


def test_same_rows_give_the_same_files(spark, archive):
    path, rows = scratch_path(spark, "test-warc"), cases()
    random.Random(9).shuffle(rows)
    warc.write_archives(pages_table(spark, rows).repartition(7), path, roll_bytes=4000)
    assert contents(path) == contents(archive[0])


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_RANGE", 3000)
    path = scratch_path(spark, "test-warc")
    manifest = warc.write_archives(pages_table(spark, cases()), path)
    assert manifest.select("range_id").distinct().count() > 5
    found = warc.read_archives(spark, path).collect()
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute(cases())
    ids = [(r.range_id, r.seq) for r in manifest.orderBy("range_id", "seq").collect()]
    assert len(ids) == len(set(ids))


def test_publishing_may_be_repeated_and_misses_nothing(tmp_path):
    import pyarrow as pa

    (tmp_path / "data").mkdir()
    (tmp_path / "staging").mkdir()
    (tmp_path / "staging" / "a.1").write_bytes(b"12345")
    batch = pa.RecordBatch.from_pylist([{"file": "a", "staged": "a.1", "bytes": 5}])
    publish = warc._publisher(str(tmp_path / "data"), str(tmp_path / "staging"))
    assert list(publish(iter([batch]))) and list(publish(iter([batch])))
    assert (tmp_path / "data" / "a").read_bytes() == b"12345"
    with pytest.raises(FileNotFoundError):
        list(publish(iter([pa.RecordBatch.from_pylist([{"file": "b", "staged": "b.1", "bytes": 5}])])))


def test_damage_is_noticed(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages_table(spark, cases()[:20]), path)
    name = os.listdir(f"{path}/data")[0]
    data = open(f"{path}/data/{name}", "rb").read()
    open(f"{path}/data/{name}", "wb").write(data[:-9] + b"x" * 9)
    with pytest.raises(Exception):
        warc.read_archives(spark, path).collect()
    open(f"{path}/data/{name}", "wb").write(data[:-9])
    with pytest.raises(Exception, match="size"):
        warc.read_archives(spark, path).collect()


def test_text_ids_and_empty_table(spark):
    path = scratch_path(spark, "test-warc")
    rows = [("a\r\n b%20é", "u", "x" * 2000), ("b", "u", "x" * 2000), ("", None, "y")]
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    found = {r.id: r for r in warc.read_archives(spark, path, "string").collect()}
    assert set(found) == {"a\r\n b%20é", "b", ""} and found["a\r\n b%20é"].refers_to == "b"
    path = scratch_path(spark, "test-warc")
    assert warc.write_archives(pages_table(spark, []), path).count() == 0
    assert warc.read_archives(spark, path).count() == 0
