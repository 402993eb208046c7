"""The registered queries and the pipeline on the smallest tables."""

import numpy as np
import pytest

import corpus_pipeline
from foliomark.llm import queries as q
from foliomark.llm.quality import base_failed, statistics
from foliomark.llm.secrets import candidates
from foliomark.llm.simhash import fingerprint
from foliomark.session import run_folder

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert [n.split("_")[0] for n in q.queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(q.oracle_sql()) <= set(q.queries())


@pytest.mark.parametrize("name", [n for n in q.queries() if n not in q.oracle_sql()])
def test_whole_tables(spark, name):
    table = "embeddings" if name.startswith("op2") else "documents"
    rows = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    found = q.queries()[name](spark, SMALL)
    assert found.count() == rows or name.startswith("op7")


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        folder = run_folder(spark, "stage")
        stage(spark, seen[-1], SMALL).write.parquet(folder)
        seen.append(spark.read.parquet(folder))
    assert all(s.columns == docs.columns for s in seen[:-1])
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in seen[:-1]]
    # quality: what the fixed rules fail is gone
    failed = {d for d, t in texts[0].items() if base_failed(np.array([statistics(t)[0]]))[0]}
    assert failed and not failed & set(texts[1])
    # near duplicates: one of each component of the input, the smallest
    ids = sorted(texts[1])
    prints = {d: fingerprint(texts[1][d]) for d in ids}
    group = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert set(texts[2]) == set(group.values())
    # secrets: same documents, no vendor's key left
    assert set(texts[3]) == set(texts[2])
    assert not any(k == "vendor" for t in texts[3].values() for _, _, k in candidates(t))
    # the mix takes known documents, whole
    assert set(texts[4]) <= set(texts[3]) and all(texts[3][d] == t for d, t in texts[4].items())
    assert seen[5].count() == seen[4].count() and seen[5].columns == ["doc_id", "source", "n_tokens", "ids"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def odd_rows():
    """Null in any column, empty and long texts, repeated rows."""
    text = "Every sentence here says something of its own about rivers, hills and the towns between them. "
    good = [" ".join(f"{w}{i}" if k % 3 == 0 else w for k, w in enumerate(text.split() * 5)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(good)]
    rows += [rows[0], rows[0], (None, good[3], "en", "s0", 9), (20, None, "de", "s1", None), (21, "", None, None, 0), (22, "  \n", "en", "s0", 3)]
    rows += [(None, None, None, None, None), (23, good[5] + " " + "end " * 30_000, "fr", None, None), (24, None, None, "s1", 4)]
    return rows


def test_stages_of_odd_rows(spark):
    """Each stage by itself, on columns that clash with names it uses; what it keeps are rows it was given."""
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.selectExpr("*", "'x' AS label", "'y' AS node", "'z' AS copies")
    rows = [tuple(r) for r in more.collect()]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, more, SMALL)
        if name == "BPE encoding":
            assert found.count() == len(rows)
            continue
        assert found.columns == more.columns
        kept = [tuple(r) for r in found.collect()]
        if name != "secret scans":
            assert set(map(repr, kept)) <= set(map(repr, rows)), name
        else:
            assert sorted(map(repr, kept)) == sorted(map(repr, (r[:4] + ((len(r[1]) if r[1] is not None else None) if r[4] is not None else None,) + r[5:] for r in rows)))
        if name == "quality rules":
            assert not {20, 21, 22, 24} & {r[0] for r in kept}
        if name == "SimHash near-dedup":
            assert len(kept) < len(rows) and sum(r[0] == 0 for r in kept) == 1
