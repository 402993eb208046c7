"""URL filters and source mixing against brute force."""

import hashlib
import random
import re

import pytest

from foliomark.llm import mixing, url_filter

DOCS = "doc_id long, text string, source string, hash string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def judged(url, rules, default):
    host, path = parts(url)
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if h is not None and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or "")
        for p in [p or ""]
    ]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else default)


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_against_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    pick = random.Random(3)
    label, step = lambda: pick.choice(["a", "b", "co", "", "É"]), lambda: pick.choice(["x", "y", "", "xy"])
    host = lambda: ".".join(label() for _ in range(pick.randint(1, 4)))
    path = lambda: "".join("/" + step() for _ in range(pick.randint(0, 4)))
    rules = [(host(), path(), pick.choice(["allow", "block"])) for _ in range(60)]
    rules += [("a", None, "block"), (None, "/", "block"), ("b", "/", "other"), ("co", "/x", "allow"), ("co", "/x", "block")]
    urls = [f"http://{host().upper()}{path()}{pick.choice(['', '?q=/x', '#/y'])}" for _ in range(300)]
    urls += [None, "", "no scheme/x", "http://", "x://y://a/b", "http://a" + "/x" * 3000, "http://" + "a." * 3000 + "co/x", "h://a/x\ny"]
    urls += urls[:20]
    rows = [(i, u, "kept", i) for i, u in enumerate(urls)]
    found = url_filter.filter_urls(
        spark.createDataFrame(rows, "page_id long, url string, host string, h long"),
        spark.createDataFrame(rules, "host string, path string, verdict string"), default="block",
    )
    assert found.columns == ["page_id", "url", "h", "host", "path", "rule", "verdict"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((i, u, i, *judged(u, rules, "block"))) for i, u in enumerate(urls))


def test_urls_empty_tables(spark):
    urls = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r)[2:] for r in url_filter.filter_urls(urls, rules).collect()] == [("a", "/", None, "allow")]
    assert url_filter.filter_urls(urls.limit(0), rules).collect() == []


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixed(rows, weights=(5, 2, 1), epochs=3):
    """Target and words taken by (source, doc_id, size), as a list."""
    sizes = {}
    for d, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(epochs * sizes[s]) for s in over}
        left, open_ = left - sum(epochs * sizes[s] for s in over), open_ - over
    out = []
    for s in order:
        own = [(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d is not None, d or 0, words(t)) for d, t, x, _ in rows if x == s]
        passes, rest = divmod(int(target[s] + 0.5), sizes[s]) if sizes[s] else (0, 0)
        for _, known, d, n in sorted(own):
            part = min(n, rest)
            rest -= part
            out.append((d if known else None, s, n, sizes[s], round(target[s], 6), passes * n + part))
    return sorted(map(repr, out))


def sample_docs():
    pick = random.Random(5)
    rows = [(i, "w " * pick.randint(0, 30), pick.choice(["a", "b", "b", "b", "é", "Z", None, "tiny"]), "x") for i in range(200)]
    rows += [(7, "one two", "a", "x")] * 5 + [(None, None, None, None), (None, "a b", "a", None), (900, "\t\x0b", "empty", "x")]
    return [r if r[2] != "tiny" else (r[0], "w w", "tiny", "x") for r in rows]


def test_mix_against_brute_force(spark):
    rows = sample_docs()
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix_sources(docs).collect()
    assert sorted(repr((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken)) for r in found) == mixed(rows)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    blank = mixing.mix_sources(spark.createDataFrame([(1, " ", "a", "x")], DOCS)).collect()
    assert [tuple(r) for r in blank] == [(1, "a", 0, 0, 0.0, 0)]


def test_mix_in_many_buckets(spark, monkeypatch):
    from foliomark.llm import common

    monkeypatch.setattr(common, "BUCKET_ROWS", 3)
    rows = sample_docs()
    found = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(repr((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken)) for r in found) == mixed(rows)


def test_mixed_documents_stay_whole(spark):
    rows = [(i, "w " * (i % 9 + 1), s, f"h{i}") for i in range(90) for s in ["ab"[i % 2]]]
    docs = spark.createDataFrame(rows, DOCS)
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_sources(docs).collect()}
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    copies = {}
    for r in found.collect():
        assert tuple(r) == rows[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {d: -(-t // n) for d, (n, t) in taken.items() if t}


@pytest.mark.parametrize("bucket_rows", [500, 3])
def test_rows_that_agree_are_mixed_one_by_one(spark, monkeypatch, bucket_rows):
    from foliomark.llm import common

    monkeypatch.setattr(common, "BUCKET_ROWS", bucket_rows)
    rows = [(None, f"t{i} w w", "ab"[i % 2], f"h{i}") for i in range(70)] + [(1, "w w", "a", "x")] * 3 + [(2, " ", "a", "x")] * 4
    docs = spark.createDataFrame(rows, DOCS)
    target, out = {}, {}
    for r in mixing.mix_sources(docs).collect():
        target[r.source] = int(r.target + 0.5)
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    for r in found.collect():
        assert tuple(r) in rows
        out[r.source] = out.get(r.source, 0) + words(r.text)
    assert all(target[s] <= out[s] < target[s] + 3 for s in target), (target, out)


def test_copies_are_expanded_without_long_arrays(spark, monkeypatch):
    from foliomark.llm import common

    monkeypatch.setattr(common, "SEQUENCE", 3)
    df = spark.createDataFrame([(1, 7), (2, 1), (3, 0), (4, 3)], "k long, n long")
    assert sorted(map(tuple, common.expand_copies(df, "n", "i").select("k", "i").collect())) == sorted(
        (k, i) for k, n in [(1, 7), (2, 1), (4, 3)] for i in range(n)
    )


def test_running_sums_by_range(spark):
    """Places and sums over many partitions are those of one sorted list; null sources come last."""
    from pyspark.sql import functions as F

    from foliomark.llm.mixing import in_order, source_targets

    rows = [(f"s{i * 37 % 500:03d}", i % 11 + 1) for i in range(500)] + [(None, 4)]
    frame = spark.createDataFrame(rows, "source string, source_size long")
    found = sorted((r.place, r.source, r.before_source_size) for r in in_order(frame, [F.col("source").asc_nulls_last()], "source_size").collect())
    wanted, total = [], 0
    for place, (source, size) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))):
        wanted.append((place, source, total))
        total += size
    assert found == wanted
    targets = source_targets(frame).collect()
    assert abs(sum(r.target for r in targets) - total) < 1e-6 * total and all(r.target <= 3 * r.source_size for r in targets)
    assert source_targets(frame.limit(0)).collect() == []
