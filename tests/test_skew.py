"""Large groups: the sliced way must give what the usual way gives."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomark.operators import documents as d
from foliomark.operators import order as o
from foliomark.operators import skew
from foliomark.operators import tables as tab
from foliomark.operators.parts import clean_body, ordered_text

from .helpers import plain_document
from .test_text import PIECES

pytestmark = pytest.mark.usefixtures("sliced")


def whole_texts(df, name):
    """Join the parts of every document; also how many parts it had."""
    texts = {}
    for row in df.orderBy("doc_id", "part_no").collect():
        texts.setdefault(row["doc_id"], []).append(row[name])
    return {key: "".join(parts) for key, parts in texts.items()}, {
        key: len(parts) for key, parts in texts.items()
    }


def test_no_large_group_means_a_plain_plan(spark):
    df = spark.range(100).selectExpr("id % 10 as doc_id", "id as image_no")
    large = skew.find_large_groups(df, ["doc_id"], 10)
    assert not large
    assert large.without(df) is df


def test_number_rows(spark):
    rows = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 1 else id % 50 end as doc_id", "id * 7 % 3001 as image_no"
    )
    usual = skew.number_rows(rows, ["doc_id"], ["image_no"], "n")
    sliced = skew.number_rows(rows, ["doc_id"], ["image_no"], "n", group_rows=500)
    assert sorted(usual.collect()) == sorted(sliced.collect())
    large = skew.find_large_groups(rows, ["doc_id"], 500)
    assert large.number == 1
    slices = skew.slice_groups(large.only(rows), ["doc_id"], ["image_no"])
    assert slices.select("_slice").distinct().count() > 1


def test_image_numbers_of_a_large_document(spark):
    rows = spark.range(2000).selectExpr(
        "id % 2 as doc_id",
        "cast(id / 100 as int) as page_no",
        "id as image_no",
        "id % 5 <> 0 as decoded",
        "id % 7 <> 0 as saved",
    )

    def numbers(group_rows):
        images = o.number_images(rows, group_rows=group_rows)
        figures = o.number_figures(images, group_rows=group_rows)
        return sorted(figures.select("doc_id", "image_no", "image_number", "figure").collect())

    assert numbers(None) == numbers(100)


def test_join_per_group(spark):
    rows = spark.range(1000).selectExpr("case when id < 400 then 0 else id % 9 end as doc_id", "id")
    groups = spark.createDataFrame([(0, "a"), (3, "b"), (11, "c")], "doc_id long, tag string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        usual = skew.join_per_group(rows, groups, ["doc_id"], how)
        sliced = skew.join_per_group(rows, groups, ["doc_id"], how, group_rows=300)
        assert sorted(map(repr, usual.collect())) == sorted(map(repr, sliced.collect())), how


def test_ordered_text_in_parts(spark):
    rows = spark.range(1000).selectExpr(
        "id % 3 as doc_id", "id as line_no", "concat('line ', id, repeat('x', cast(id % 13 as int))) as text"
    )
    usual, _ = whole_texts(
        ordered_text(rows, ["doc_id"], ["line_no"], "text", "\n").union(), "text"
    )
    parts = ordered_text(
        rows, ["doc_id"], ["line_no"], "text", "\n", group_rows=333, part_chars=1000
    )
    joined, numbers = whole_texts(parts.union(), "text")
    assert joined == usual
    # characters alone decide on the cuts, not which limit made a group a large one
    assert all(number > 3 for number in numbers.values())
    one = ordered_text(rows, ["doc_id"], ["line_no"], "text", "\n", group_rows=10)
    assert one.large.number == 3
    assert whole_texts(one.union(), "text") == (usual, {0: 1, 1: 1, 2: 1})


def test_ordered_text_keeps_a_large_group_without_text(spark):
    rows = spark.range(50).selectExpr("1 as doc_id", "id as line_no", "cast(null as string) as text")
    row = ordered_text(rows, ["doc_id"], ["line_no"], "text", "\n", group_rows=10).union().first()
    assert (row["part_no"], row["text"]) == (0, "")


BLOCKS = st.lists(
    st.one_of(
        PIECES,
        st.sampled_from(
            ["\n## Página 1\n", "text", "• item", "* item", "•", "##", "\x01", "a\n", " \n• b", "t  \n \n"]
        ),
    ),
    min_size=1,
    max_size=60,
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(BLOCKS, min_size=4, max_size=8), st.integers(1, 40))
def test_cleaned_parts_join_to_the_cleaned_whole(spark, documents, part_chars):
    rows = [
        (doc_id, number, text)
        for doc_id, blocks in enumerate(documents)
        for number, text in enumerate(blocks)
    ]
    wanted = {
        doc_id: plain_document(blocks)
        for doc_id, blocks in enumerate(documents)
        if any(block.strip() for block in blocks)
    }
    df = spark.createDataFrame(rows, "doc_id long, k long, md string")
    df = d.drop_blank_blocks(df)
    args = (df, ["doc_id"], ["k"], "md")
    assert whole_texts(clean_body(*args).union(), "body")[0] == wanted
    parts = clean_body(*args, group_rows=1, part_chars=part_chars).union()
    assert whole_texts(parts, "body")[0] == wanted
    ends = parts.groupBy("doc_id").agg(
        F.count_if("last_part").alias("n"), F.max_by("last_part", "part_no").alias("at_end")
    )
    assert all(row["n"] == 1 and row["at_end"] for row in ends.collect())


def test_a_long_document_really_is_cut(spark):
    texts = [random.Random(i).choice(["• x", "para", "\n## Página 2\n"]) + f" {i}" for i in range(2000)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "doc_id long, k long, md string")
    parts = clean_body(df, ["doc_id"], ["k"], "md", group_rows=100, part_chars=1000).union()
    joined, numbers = whole_texts(parts, "body")
    assert joined[1] == plain_document(texts)
    assert numbers[1] >= 15
    assert max(len(row["body"]) for row in parts.collect()) < 1200


def test_tables_of_a_large_page(spark):
    rows = [
        (1, 0, table, extractor, row, [f"{row}", "x"][: 1 + row % 2] if table != 2 else [])
        for table in range(4)
        for extractor in (1, 2)
        for row in range(40)
    ] + [(2, 0, 0, 2, 0, ["only", "header"]), (3, 0, 0, 1, 0, ["only", "header"])]
    df = spark.createDataFrame(
        rows, "doc_id long, page_no int, table_no int, extractor int, row_no long, cells array<string>"
    )

    def texts(**limits):
        out = {}
        for row in tab.page_tables_md(df, **limits).orderBy(*tab.TABLE, "part_no").collect():
            key = (row["doc_id"], row["table_no"], row["extractor"])
            out[key] = out.get(key, "") + row["md"]
        return out

    usual = texts()
    assert set(usual) == {(1, 0, 1), (1, 1, 1), (1, 3, 1), (3, 0, 1)}
    assert usual[(3, 0, 1)] == "| only | header |\n| --- | --- |"
    assert texts(group_rows=10, part_chars=50) == usual


def test_image_section_of_a_large_document(spark):
    figures = spark.range(500).selectExpr(
        "case when id < 300 then 1 else 2 end as doc_id",
        "case when id < 300 then id + 1 else id - 299 end as figure",
        "concat('i_', id, '.png') as image_name",
    )
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    usual = d.attach_image_section(docs, figures).na.fill("")
    cut = d.attach_image_section(docs, figures, group_rows=250, part_chars=500).na.fill("")
    assert whole_texts(cut, "image_section")[0] == whole_texts(usual, "image_section")[0]
    assert cut.count() > 3


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("cells", [4, 64, 65_536])
def test_sketch_finds_the_same_groups(spark, monkeypatch, seed, cells):
    """Groups of random sizes, few cells and many: what is found is what an exact count finds."""
    monkeypatch.setattr(skew, "CELLS", cells)
    pick = random.Random(seed)
    rows = [(pick.choice([None, *range(60)]) if pick.random() < 0.7 else 7, pick.randrange(3), "x" * pick.randint(0, 9)) for _ in range(1_500)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    limit, most = 40, 150
    groups = {}
    for d, p, text in rows:
        groups.setdefault((d, p), []).append(len(text))
    wanted = {k for k, v in groups.items() if len(v) > limit or sum(v) > most}
    found = skew.find_large_groups(df, ["doc_id", "page_no"], limit, F.length("text"), most)
    assert {tuple(r) for r in found.keys_df.collect()} == wanted and found.number == len(wanted)
    assert found.rows == sum(len(groups[k]) for k in wanted)


def test_no_full_cell_no_key_is_counted(spark):
    df = spark.range(100_000).withColumnRenamed("id", "doc_id")
    found = skew.find_large_groups(df, ["doc_id"], 5_000)
    assert not found and found.number == 0 and found.keys_df.count() == 0
    assert skew.suspects(df, ["doc_id"], lambda rows, sums: rows > 5_000, F.lit(0)) is None
    all_full = skew.suspects(df, ["doc_id"], lambda rows, sums: rows > 2_000, F.lit(0), cells=16)
    assert all_full.count() == 100_000
