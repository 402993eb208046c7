"""Components, SimHash and embeddings against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from foliomark.llm import components, embeddings, simhash

DOCS = "doc_id long, text string, print string"


def reach(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, shape):
    pick = random.Random(2)
    n = 120
    links = {
        "random": [(pick.randrange(n), pick.randrange(n)) for _ in range(70)],
        "path": [(i, i + 1) for i in range(n - 1)],
        "star": [(5, i) for i in range(0, n, 2)] * 2,
    }[shape]
    found = dict(map(tuple, components.connected(spark.createDataFrame(links, "a long, b long")).collect()))
    roots = reach(n, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert found == {i: roots[i] for i in linked}


def test_components_of_nothing(spark):
    assert components.connected(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_forest():
    forest = components.Forest(6)
    forest.join(np.array([5, 3, 3]), np.array([4, 4, 1]))
    rows, roots = forest.links()
    assert set(roots[np.isin(rows, [3, 4, 5])]) == {1} and len(rows) == 3


def plain_print(text):
    tokens = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO", "É è a b c", "a b c d " * 50, "x\u00a0y z\x1cw", "a b a b a b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_long_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    text = " ".join(str(i * i) for i in range(400))
    assert simhash.fingerprint(text) == plain_print(text)


def texts():
    pick = random.Random(8)
    base = [" ".join(pick.choice("abcdefghijkl") * pick.randint(1, 4) for _ in range(80)) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        for _ in range(pick.randint(1, 12)):
            w = t.split()
            w[pick.randrange(len(w))] = "new"
            out.append(" ".join(w))
    return out + [None, "", "  "] + base[:5]


@pytest.mark.parametrize("tile", [5, 16_384])
def test_simhash_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "RUN", 4)
    monkeypatch.setattr(simhash.fingerprint_components, "__defaults__", (simhash.RADIUS, tile))
    rows = [(1000 - i if i % 17 else None, t, "clash") for i, t in enumerate(texts())]
    prints = [plain_print(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    roots, least = reach(len(rows), links), {}
    for r, (d, _, _) in zip(roots, rows, strict=True):
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    assert len(set(roots)) < len(rows) - 20
    docs = spark.createDataFrame(rows, DOCS)
    found = simhash.simhash_components(docs).collect()
    wanted = [(d, f"{p:016x}", least[r]) for (d, _, _), p, r in zip(rows, prints, roots, strict=True)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))

    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(x for x in least.values() if x is not None) and kept.count() == len(least)


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).collect() == [] == simhash.simhash_dedup(empty).collect()


def test_large_tiles_link_like_all_pairs():
    random_ = np.random.default_rng(4)
    a = random_.integers(0, 1 << 63, 700).astype(np.uint64)
    near = a[:200] ^ (np.uint64(1) << random_.integers(0, 63, 200).astype(np.uint64)) ^ np.uint64(5)
    both = np.concatenate([a, near])
    x, y = simhash.tile_links(a, near)
    place = {int(v): i for i, v in enumerate(both)}
    found = reach(len(both), [(place[int(p)], place[int(q)]) for p, q in zip(x, y, strict=True)])
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ near[None, :]) <= 3)
    assert found[: len(a)] == reach(len(both), [(int(p), int(q) + len(a)) for p, q in zip(i, j, strict=True)])[: len(a)] and len(i) >= 200


def vectors():
    random_ = np.random.default_rng(1)
    base = random_.standard_normal((300, 24))
    rows = [list(map(float, v)) for v in base]
    for k in range(40):
        rows += [list(map(float, base[k] + random_.standard_normal(24) * s)) for s in (0.05, 0.1, 0.2)]
    rows += [list(map(float, base[50] + random_.standard_normal(24) * 0.05)) for _ in range(60)]
    rows += [rows[0], rows[0], [3.0 * x for x in rows[1]]]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] * 24, rows[3][:12], [1e-200] * 24]
    return rows + odd + [[0.0] * 24]


def brute_links(data):
    """(vec_id, n_links, component_id, kept) of every vector by comparing all pairs."""
    unit = []
    for v in data:
        x = None if v is None or any(c is None for c in v) else np.array(v)
        good = x is not None and len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if good else None)
    n = len(data)
    links = []
    for size in {len(u) for u in unit if u is not None}:
        own = np.array([i for i, u in enumerate(unit) if u is not None and len(u) == size])
        x = np.stack([unit[i] for i in own])
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        links += [(int(own[i]), int(own[j])) for i, j in zip(*np.nonzero(near), strict=True)]
    roots, degree = reach(n, links), [0] * n
    for i, _ in links:
        degree[i] += 1
    return [(i, degree[i], roots[i], i == roots[i]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"exact": True}, {"block": 64, "overlap": 32}, {"small": 9}, {"small": 9, "exact": True}])
def test_embeddings_against_brute_force(spark, monkeypatch, options):
    options = dict(options)
    if small := options.pop("small", None):
        monkeypatch.setattr(embeddings, "SMALL", small)
        monkeypatch.setattr(embeddings, "CELL_BYTES", 8 * 24 * 50)
    data = vectors()
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(data)], "vec_id long, embedding array<double>, node string")
    assert sorted(map(tuple, embeddings.embedding_components(frame, **options).collect())) == brute_links(data)


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_a_null_component_is_no_shorter_vector(spark, turned, exact):
    forms = [[1.0, 2.0], [1.0, None, 2.0], [None, 1.0, 2.0], [1.0, float("nan"), 2.0]]
    rows = [(i, v) for i, v in enumerate(forms[::-1] if turned else forms)]
    found = embeddings.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), exact=exact)
    assert sorted(map(tuple, found.collect())) == [(i, 0, i, True) for i in range(4)]


def scattered(n, seed=3, dims=64):
    """Lone pairs just above the threshold, a dense cone that holds a third of all, and pairs below the threshold."""
    random_ = np.random.default_rng(seed)
    base = random_.standard_normal((n // 2, dims))
    cone = n // 6
    base[:cone] = base[0] + base[:cone] * 0.3
    near = base + random_.standard_normal(base.shape) * 0.45 * np.linalg.norm(base, axis=1)[:, None] / 8
    return np.concatenate([base, near, near[:20]])


@pytest.mark.parametrize("tile", [32 << 20, 8 * 64 * 50])
def test_exact_embeddings_miss_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "CELL_BYTES", tile)
    monkeypatch.setattr(embeddings, "COLUMNS", 70)
    monkeypatch.setattr(embeddings, "ROWS", 40)
    data = [list(map(float, v)) for v in scattered(700)]
    frame = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    found = sorted(map(tuple, embeddings.embedding_components(frame, exact=True).collect()))
    assert found == brute_links(data) and len({r[2] for r in found}) > 150


def test_passes_reach_their_recall(spark):
    """Narrow windows, so that the passes have to do the work; links are never too many."""
    data = [list(map(float, v)) for v in scattered(3_000)]
    frame = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    wanted = brute_links(data)
    found = sorted(map(tuple, embeddings.embedding_components(frame, block=128, overlap=64).collect()))
    assert all(a[1] <= b[1] for a, b in zip(found, wanted, strict=True))
    assert sum(a[1] for a in found) >= 0.99 * sum(b[1] for b in wanted)
    few = sorted(map(tuple, embeddings.embedding_components(frame, block=128, overlap=64, passes=1).collect()))
    assert sum(a[1] for a in few) < sum(a[1] for a in found)


def test_passes_grow_with_the_table():
    counts = [embeddings.passes_for(n, 0.999, 0.9) for n in (100, 50_000, 10**6, 10**9)]
    assert counts[0] == 1 and counts == sorted(counts) and counts[-1] < 300


def test_pairs_at_the_threshold_are_decided_in_double_precision(spark):
    """Cosines a hair above and below 0.9, which single precision can't tell apart."""
    rows = []
    for i in range(40):
        angle = np.arccos(0.9) + (1e-9 if i % 2 else -1e-9)
        rows += [(2 * i, [0.0] * i + [1.0, 0.0] + [0.0] * 50), (2 * i + 1, [0.0] * i + [float(np.cos(angle)), float(np.sin(angle))] + [0.0] * 50)]
    found = embeddings.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, found)) == brute_links([v for _, v in rows])


def test_embeddings_without_ids_or_rows(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None), (2, [0.0, 1.0])]
    found = embeddings.embedding_components(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(
        map(repr, [(None, 1, 4, False), (4, 1, 4, True), (None, 0, None, True), (2, 0, 2, True)])
    )
    assert embeddings.embedding_components(spark.createDataFrame([], kind)).collect() == []
