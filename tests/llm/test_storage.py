"""WARC archives and sharding."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from foliomark.llm import sharding, warc
from foliomark.session import run_folder

PAGES = "page_id long, url string, html string, original long"


def pages():
    rows = [(i, f"http://a/{i}", f"<p>é {i % 7}</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", i) for i in range(40, 0, -1)]
    rows += [(50, None, None, 1), (51, "u\r\nWARC-Type: x", "", 1), (52, "http://b/", "x" * 300_000, 1), (None, "http://n/", "x" * 300_000, 1)]
    return rows + [(None, "http://m/", "only here", 1)] * 2 + [(60, "http://r/", "twice", 1)] * 2


def test_round_trip(spark):
    rows = pages()
    folder = run_folder(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, PAGES), folder)
    found = warc.read_warc(spark, folder).withColumn("id", warc.page_number(warc.F.col("record_id"))).collect()
    assert len(found) == len(rows)
    least = {}
    for i, _, h, _ in rows:
        least[h or ""] = min([x for x in (least.get(h or ""), i) if x is not None], default=None)
    html = {(i, u): h or "" for i, u, h, _ in rows}
    for r in found:
        text = next(h for (i, u), h in html.items() if i == r.id and ((u or "").replace("\r", " ").replace("\n", " ") == r.target_uri))
        first = least[text]
        revisit = first is not None and r.id != first
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (f"<urn:x-page:{first}>" if revisit else None)
        assert bytes(r.payload) == (b"" if revisit else text.encode()) and r.payload_length == len(text.encode())
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_pushed_filters(spark):
    folder = run_folder(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(pages(), PAGES), folder)
    every = warc.read_warc(spark, folder, payload=False)
    assert all(r.payload is None for r in every.collect())
    revisits = every.where("record_type = 'revisit' AND content_length > 0")
    plan = revisits._jdf.queryExecution().toString()
    assert "record_type" in plan.split("== Physical Plan ==")[1]
    assert revisits.count() == every.toPandas().query("record_type == 'revisit'").shape[0] > 0
    reader = warc.WarcReader("file://" + folder.removeprefix("file:"), True)
    kinds = warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 5)
    assert list(reader.pushFilters(list(kinds))) == [kinds[1]] and reader.wanted == [("warc-type", frozenset(["revisit"]))]


def test_unwanted_payloads_are_not_read():
    class Watched(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Watched.taken += n
            return super().read(n)

    record = b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: 1000\r\n\r\n" + b"x" * 1000 + b"\r\n\r\n"
    stream = Watched(record % b"response" + record % b"metadata" + record % b"response")
    found = list(warc.records(stream, [("warc-type", frozenset(["metadata"]))], True))
    assert len(found) == 1 and found[0][-1] == b"x" * 1000 and Watched.taken == 1000
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"HTTP/1.1 200"), [], True))


def test_small_payloads_and_no_pages(spark):
    rows = [(1, "a", "xx", 1), (2, "b", "xx", 1), (3, "c", "xxxx", 1), (4, "d", "xxxx", 1)]
    kinds = warc.with_revisits(spark.createDataFrame(rows, PAGES), least_bytes=3).collect()
    assert {r.page_id: r.record_type for r in kinds} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    folder = run_folder(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([], PAGES), folder)
    assert warc.read_warc(spark, folder).collect() == []


def test_repeats_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REPEATED", -1)
    kinds = warc.with_revisits(spark.createDataFrame(pages(), PAGES)).groupBy("record_type").count().collect()
    assert dict(map(tuple, kinds))["revisit"] == 33 + 1 + 1


def smallest(sizes, shards):
    """By dynamic programming: the least possible largest shard."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends[1:].astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[j - 1] if j else 0, ends[i + 1] - ends[j]) for j in range(i + 1)) for i in range(len(sizes))])
    return int(best[-1])


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    pick = random.Random(seed)
    shards = pick.choice([2, 5, 9])
    heavy = [500] * (seed % 2)
    groups = sorted((hashlib.sha256(str((seed, i)).encode()).hexdigest(), s) for i, s in enumerate([pick.randint(8, 60) for _ in range(70)] + heavy))
    starts, capacity = sharding.minimax_cuts(spark.createDataFrame(groups, "digest string, size long"), shards)
    assert capacity == smallest([s for _, s in groups], shards) and len(starts) == shards - 1
    totals = [0] * shards
    for d, s in groups:
        totals[sum(d >= x for x in starts)] += s
    assert max(totals) == capacity and (min(totals) > 0)


def test_shards_of_documents(spark):
    pick = random.Random(0)
    rows = [(i, "é" * pick.randint(0, 90), "x") for i in range(300)] + [(i, "copy", "x") for i in range(500, 700)]
    rows += [(None, None, None), (None, "", "x")] + [(7, "same row", "x")] * 30
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, digest string"), 6).collect()
    size = lambda t: len((t or "").encode()) + 8
    wanted = sorted(repr((d, size(t), zlib.crc32((t or "").encode()))) for d, t, _ in rows)
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in found) == wanted
    homes, slots, totals = {}, {}, {}
    for r in found:
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
        totals[r.shard] = totals.get(r.shard, 0) + r.size
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(6))
    groups = {}
    for d, t, _ in rows:
        key = hashlib.sha256((t or "").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + size(t)
    assert max(totals.values()) == smallest([groups[k] for k in sorted(groups)], 6)


def test_few_or_no_groups(spark):
    kind = "doc_id long, text string"
    assert sharding.shard_documents(spark.createDataFrame([], kind), 4).collect() == []
    few = sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, "b")], kind), 4).collect()
    assert len({r.shard for r in few}) == 2 and all(r.slot == 0 for r in few)


def test_folders_are_resolved_by_the_default_file_system(spark):
    """A path without scheme means the same to the writer, which is Spark's, and to the reader."""
    from foliomark.sources.paths import qualified

    settings = spark._jsc.hadoopConfiguration()
    before = settings.get("fs.defaultFS")
    settings.set("fs.defaultFS", "hdfs://127.0.0.1:9000")
    try:
        assert qualified(spark, "/user/x/warc") == "hdfs://127.0.0.1:9000/user/x/warc"
        assert qualified(spark, "file:/user/x") == "file:/user/x"
    finally:
        settings.set("fs.defaultFS", before)
    folder = run_folder(spark, "warc-test").removeprefix("file:")
    warc.write_warc(spark.createDataFrame(pages(), PAGES), folder)
    assert warc.read_warc(spark, folder).count() == len(pages())
