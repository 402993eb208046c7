"""Golden rows for names, tables, order, blocks and documents."""

import pytest
from pyspark.sql import functions as F

from foliomark.functions import names as n
from foliomark.functions import tables as tb
from foliomark.operators import blocks as b
from foliomark.operators import documents as d
from foliomark.operators import gates as g
from foliomark.operators import order as o
from foliomark.operators import report as r
from foliomark.operators import tables as tab

from .helpers import apply

PAGES = (
    "doc_id long, page_no int, ocr_text string, rasterized boolean, ocr_error string, "
    "block_error boolean, image_saved boolean"
)
SHAPES = (
    "doc_id long, page_no int, shape_no long, kind string, name string, top long, left long, "
    "paragraphs array<struct<level int, text string>>, rows array<array<string>>, ocr_text string, "
    "decoded boolean, saved boolean, error string, image_name string, ocr_error string"
)


def texts(blocks):
    return [row["md"] for row in blocks.orderBy("doc_id", *b.ORDER).collect()]


# --- names -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "path, file, kind, stem",
    [
        ("a/b/Doc.v2.PDF", "Doc.v2.PDF", "pdf", "Doc.v2"),
        ("x.ppt", "x.ppt", "pptx", "x"),
        ("x.PpTx", "x.PpTx", "pptx", "x"),
        ("file:/data/photo.JPEG", "photo.JPEG", "image", "photo"),
        ("a/.pdf", ".pdf", None, ".pdf"),
        ("noext", "noext", None, "noext"),
        ("end.", "end.", None, "end."),
        ("a.txt", "a.txt", None, "a"),
    ],
)
def test_names(spark, path, file, kind, stem):
    assert apply(spark, n.file_name, [path]) == [file]
    assert apply(spark, n.file_type, [file]) == [kind]
    assert apply(spark, n.stem, [file]) == [stem]


def test_sanitized_names(spark):
    given = ['a<b>:c"d/e\\f|g?h*i', " ..name. .", "tab\there", "ok"]
    assert apply(spark, n.sanitize_name, given) == ["a_b__c_d_e_f_g_h_i", "name", "tab_here", "ok"]


def test_output_and_image_names(spark):
    assert apply(spark, lambda c: n.output_path(c, "out/"), ["A: b.pdf"]) == ["out/A_ b.md"]
    names = spark.range(1).select(
        n.image_name(F.lit("p"), F.lit(7)), n.image_name(F.lit("p"), F.lit(1000)),
        n.image_name(F.lit(""), F.lit(1)),
    ).first()
    assert tuple(names) == ("p_image_007.png", "p_image_1000.png", "image_001.png")


def test_quoted(spark):
    given = [".txt", "", "it's", "\"it's", "a\\b", "a\tb\nc\r"]
    assert apply(spark, n.quoted, given) == [repr(text) for text in given]


# --- gates -----------------------------------------------------------------------


def test_quick_gate(spark):
    lines = "\n".join(["x" * 40] * 7)
    given = [lines, lines.replace("\n", " "), "x\n" * 7, "  " + lines + "\n\n", None, "x" * 201]
    wanted = [True, False, False, True, False, False]
    assert apply(spark, g.quick_sufficient, given) == wanted


def test_embedded_text_looks_at_three_pages(spark):
    rows = [(1, 0, "x" * 30), (1, 1, "x" * 21), (2, 0, "x" * 50), (3, 0, " "), (3, 3, "x" * 99)]
    # white space counts between inked pages, and not at the ends
    rows += [(4, 0, "\n x"), (4, 1, " " * 48), (4, 2, None), (4, 2, "x \x1c\u3000"), (5, 0, " "), (5, 1, " " * 20 + "x" * 40)]
    rows += [(6, 0, "x" * 25), (6, 1, " "), (6, 2, " " * 30 + "x" * 24 + "\n" * 9), (7, 0, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, embedded_text string")
    found = {row["doc_id"]: (row["pages"], row["has_text"]) for row in g.page_facts(pages).collect()}
    assert found == {
        1: (2, True), 2: (1, False), 3: (2, False), 4: (4, False), 5: (2, False), 6: (3, True), 7: (1, False)
    }


# --- tables ----------------------------------------------------------------------

RAGGED = [["h1"], ["a", "b", "c"], ["x", "y"]]


def render(spark, step, rows):
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    return df.select(step(F.col("rows"))).first()[0]


def test_page_table_is_as_wide_as_its_widest_row(spark):
    lines = ["| h1 |  |  |", "| --- | --- | --- |", "| a | b | c |", "| x | y |  |"]
    assert render(spark, tb.table_md_padded, RAGGED) == "\n".join(lines)
    assert render(spark, tb.table_md_padded, []) is None
    assert render(spark, tb.table_md_padded, [["a|b\nc"]]) == "| a|b\nc |\n| --- |"
    wanted = "| a |  | c |\n| --- | --- | --- |"
    assert render(spark, tb.table_md_padded, [["a", None, "c"]]) == wanted
    assert render(spark, tb.table_md_header_width, [["a", None, "c"]]) == wanted


def test_slide_table_is_as_wide_as_its_header(spark):
    lines = ["| h1 |", "| --- |", "| a |", "| x |"]
    assert render(spark, tb.table_md_header_width, RAGGED) == "\n".join(lines)
    tidy = render(spark, tb.table_md_header_width, [[" A\nB ", "C"], ["1"]])
    assert tidy == "| A B | C |\n| --- | --- |\n| 1 |  |"
    assert render(spark, tb.table_md_header_width, []) is None


def test_second_extractor_only_where_the_first_found_nothing(spark):
    rows = [
        (1, 0, 0, 1, 0, ["a"]),
        (1, 0, 0, 2, 0, ["b"]),
        (1, 0, 0, 2, 1, ["b"]),
        (1, 1, 0, 1, 0, []),
        (1, 1, 0, 2, 0, ["name", "n"]),
        (1, 1, 0, 2, 1, [None, "2"]),
    ]
    df = spark.createDataFrame(
        rows, "doc_id long, page_no int, table_no int, extractor int, row_no long, cells array<string>"
    )
    found = [row["md"] for row in tab.page_tables_md(df).orderBy("page_no").collect()]
    assert found == ["| a |\n| --- |", "| name | n |\n| --- | --- |\n| nan | 2 |"]


# --- order -----------------------------------------------------------------------


def test_row_bands_round_halves_to_even(spark):
    df = spark.createDataFrame([(y,) for y in (10.0, 30.0, 50.0, 29.9, -10.0)], "y double")
    assert [row[0] for row in df.select(o.row_band(F.col("y"))).collect()] == [0, 40, 40, 20, 0]


def test_reading_order(spark):
    rows = [(1, 0, 1, 50.0, 12.0), (1, 0, 2, 5.0, 28.0), (1, 0, 3, 5.0, 9.0), (1, 0, 4, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, block_no long, x0 double, y0 double")
    found = o.reading_order(df).orderBy("reading_pos").collect()
    assert [row["block_no"] for row in found] == [3, 4, 2, 1]


def test_shape_order(spark):
    rows = [(1, 0, 0, 731, 4), (1, 0, 1, 12, 88), (1, 0, 2, 340, 4), (1, 0, 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, shape_no long, top long, left long")
    found = o.shape_order(df).orderBy("shape_pos").collect()
    assert [row["shape_no"] for row in found] == [3, 1, 2, 0]


def test_image_numbers_have_gaps_and_figures_do_not(spark):
    rows = [(1, 0, 0, True, True), (1, 0, 1, False, True), (1, 0, 2, True, False), (1, 1, 0, True, True)]
    df = spark.createDataFrame(
        rows, "doc_id long, page_no int, image_no long, decoded boolean, saved boolean"
    )
    found = o.number_figures(o.number_images(df)).orderBy("figure").collect()
    assert [(row["image_number"], row["figure"]) for row in found] == [(1, 1), (3, 2)]


# --- blocks ----------------------------------------------------------------------


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), PAGES)


def test_scanned_pages(spark):
    df = pages(
        spark,
        (1, 0, None, False, None, False, True),
        (1, 1, "read", True, None, False, True),
        (1, 2, " \n", True, None, False, True),
        (1, 3, None, True, "timeout", False, True),
    )
    assert texts(b.scanned_page_blocks(df)) == [
        "\n## Página 1\n",
        "\n> ⚠️ Página 1: no pudo rasterizarse. Contenido omitido.\n",
        "\n## Página 2\n",
        "read",
        "\n## Página 3\n",
        "\n> ⚠️ Página 3: OCR no produjo resultado.\n",
        "\n## Página 4\n",
        "\n> ⚠️ Página 4: no pudo procesarse (error OCR). Contenido omitido.\n",
    ]
    images = b.page_images(df)
    assert [row["page_no"] for row in images.orderBy("page_no").collect()] == [1, 2]


def test_text_pages(spark):
    df = pages(spark, (1, 0, "", True, None, False, True), (1, 1, "", True, None, True, True))
    blocks = spark.createDataFrame(
        [
            (1, 0, 1, 0, 9.0, 0.0, " second "),
            (1, 0, 2, 0, 1.0, 0.0, "first"),
            (1, 0, 3, 1, 0.0, 0.0, "picture"),
            (1, 0, 4, 0, 0.0, 0.0, " \n"),
        ],
        "doc_id long, page_no int, block_no long, block_type int, x0 double, y0 double, text string",
    )
    assert texts(b.pdf_page_blocks(df, blocks)) == [
        "\n## Página 1\n",
        "first",
        "second",
        "\n## Página 2\n",
        "\n> ⚠️ Página 2: error parcial al extraer bloques.\n",
    ]


def shape(number, kind, name="", paragraphs=None, rows=None, ocr=None, error=None, image=None, decoded=True, failed=None):
    return (1, 0, number, kind, name, number, 0, paragraphs, rows, ocr, decoded, True, error, image, failed)


def test_shapes(spark):
    frame = [(0, " Head "), (1, "one"), (2, "two"), (0, "  ")]
    df = spark.createDataFrame(
        [
            shape(0, "TEXT", "Sub TÍTULO 1", frame),
            shape(1, "TEXT", "Content", [(0, "plain")]),
            shape(2, "TABLE", rows=[["A", "B"], ["1", "2"]]),
            shape(3, "PICTURE", ocr="seen", image="d_image_001.png"),
            shape(4, "PICTURE", ocr=" "),
            shape(5, "PICTURE", ocr="lost", decoded=False),
            shape(6, "TEXT", "Content", [(0, "broken")], error="x"),
            shape(7, "LINE"),
            shape(8, "PICTURE", ocr="lost", image="d_image_002.png", failed="timeout"),
        ],
        SHAPES,
    )
    assert texts(b.shape_dispatch(df)) == [
        "### Head",
        "- one",
        "  - two",
        "plain",
        "| A | B |\n| --- | --- |\n| 1 | 2 |",
        "\n![Figura](images/d_image_001.png)\n",
        "seen",
        "\n![Figura](images/d_image_002.png)\n",
    ]


def test_slides_with_notes_and_failure(spark):
    slides = spark.createDataFrame([(1, 0, None), (1, 1, "x")], "doc_id long, page_no int, error string")
    notes = spark.createDataFrame([(1, 0, " note\n"), (1, 1, "never read"), (1, 0, " ")], "doc_id long, page_no int, text string")
    none = spark.createDataFrame([], SHAPES)
    assert texts(b.slide_blocks(slides, none, notes)) == [
        "\n## Diapositiva 1\n",
        "\n> **Notas:** note\n",
        "\n## Diapositiva 2\n",
        "\n> ⚠️ Diapositiva 2: error al procesar.\n",
    ]


def test_image_files(spark):
    df = pages(
        spark,
        (1, 0, "seen", True, None, False, True),
        (2, 0, "", True, None, False, False),
        (3, 0, None, True, "no engine", False, True),
    ).withColumn("file", F.concat(F.lit("a?"), "doc_id", F.lit(".png")))
    assert texts(b.image_doc_blocks(df, with_images=True)) == [
        "seen",
        "\n![a?1](images/a_1_image_001.png)\n",
        "\n> ⚠️ OCR no produjo resultado para a?2.png.\n",
        "\n> ⚠️ Error al aplicar OCR: no engine\n",
        "\n![a?3](images/a_3_image_001.png)\n",
    ]


# --- documents and report ----------------------------------------------------------


def test_confident_lines_keep_empty_pages(spark):
    rows = [(1, 0, 1, "a", 0.9), (1, 0, 2, "b", 0.5), (1, 0, 3, "c", 0.51), (1, 1, 1, "d", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, line_no long, text string, confidence double")
    found = d.join_ocr_lines(df, confident_only=True).orderBy("page_no").collect()
    assert [row["text"] for row in found] == ["a\nc", ""]


def test_status(spark):
    rows = [("a.pdf", "pdf", "text_pdf"), ("b.PDF", "pdf", "quick"), ("c.TXT", None, None)]
    df = spark.createDataFrame(rows, "file string, kind string, route string").withColumn("error", F.lit(None).cast("string"))
    found = [tuple(row) for row in df.select(r.file_status(), r.file_status("gpt")).collect()]
    unknown = "error: Motor OCR no soportado: 'gpt'. Opciones: ['paddle', 'surya', 'tesseract']"
    unsupported = "error: Tipo de archivo no soportado: '.txt'"
    assert found == [("ok", unknown), ("ok", "ok"), (unsupported, unsupported)]


def test_collisions(spark):
    df = spark.createDataFrame([("o/a.md",), ("o/a.md",), ("o/b.md",), (None,)], "output string")
    assert [tuple(row) for row in r.output_collisions(df).collect()] == [("o/a.md", 2)]
