"""Whole conversions: small hand-made corpora, and the same corpus in parts."""

import re

import pytest
from pyspark.sql import functions as F

from foliomark.plans.convert import DocumentTables, Options, convert
from foliomark.plans.vehicles import Vehicles
from foliomark.sources import sinks

SMALL = "/root/testdata/sf0.001"
QUICK = "\n".join(["word" * 10] * 8)
LONG = "a line that the engine read\n" * 20 + "end"
SCHEMAS = {
    "files": "doc_id long, path string",
    "quick_text": "doc_id long, text string",
    "doc_pages": "doc_id long, page_no int, embedded_text string, ocr_text string, rasterized boolean, "
    "ocr_error string, block_error boolean, image_saved boolean",
    "blocks": "doc_id long, page_no int, block_no long, block_type int, x0 double, y0 double, text string",
    "table_rows": "doc_id long, page_no int, table_no int, extractor int, row_no long, cells array<string>",
    "slides": "doc_id long, page_no int, error string",
    "shapes": "doc_id long, page_no int, shape_no long, kind string, name string, top long, left long, "
    "paragraphs array<struct<level int, text string>>, rows array<array<string>>, ocr_text string, "
    "decoded boolean, saved boolean, error string, ocr_error string",
    "notes": "doc_id long, page_no int, text string",
    "image_refs": "doc_id long, page_no int, image_no long, decoded boolean, saved boolean",
}
ROWS = {
    "files": [
        (1, "in/quick.pdf"),
        (2, "in/text.pdf"),
        (3, "in/scan.pdf"),
        (4, "in/deck.pptx"),
        (5, "in/photo.png"),
        (6, "in/broken.pdf"),
        (7, "in/note.txt"),
        (8, "in/quick.png"),
        (9, "in/long scan.pdf"),
    ],
    "quick_text": [(1, QUICK), (2, "short"), (3, None), (8, QUICK)],
    "doc_pages": [
        (1, 0, "x" * 60, None, True, None, False, True),
        (2, 0, "x" * 60, None, True, None, False, True),
        (2, 1, "", None, True, None, True, True),
        (3, 0, " ", "ocr text", True, None, False, True),
        (3, 1, None, None, False, None, False, True),
        (5, 0, None, "photo text", True, None, False, True),
        (8, 0, None, "", True, None, False, False),
        # far more OCR text than makes a text PDF
        (9, 0, "  ", LONG, True, None, False, False),
        (9, 1, "", "more", True, None, False, False),
    ],
    "blocks": [(2, 0, 1, 0, 0.0, 0.0, "• item"), (2, 0, 2, 0, 50.0, 0.0, "##  two  words")],
    "table_rows": [(2, 0, 0, 2, 0, ["a", "b"]), (2, 0, 0, 2, 1, ["1", None]), (2, 1, 0, 1, 0, ["lost"])],
    "slides": [(4, 0, None), (4, 1, "broken")],
    "shapes": [
        (4, 0, 1, "TEXT", "Title", 5, 0, [(0, "Head")], None, None, True, True, None, None),
        (4, 0, 2, "PICTURE", "p", 9, 0, None, None, "seen", True, True, None, None),
        (4, 0, 3, "PICTURE", "p", 1, 0, None, None, "lost", True, True, None, "timeout"),
        (4, 1, 1, "TEXT", "Body", 5, 0, [(0, "before it broke")], None, None, True, True, None, None),
    ],
    "notes": [(4, 0, "say"), (4, 1, "never read")],
    "image_refs": [(1, 0, 0, True, True), (1, 0, 1, True, False), (1, 1, 0, True, True), (2, 0, 0, True, True)],
}


@pytest.fixture
def tables(spark):
    return DocumentTables(
        **{name: spark.createDataFrame(ROWS[name], schema) for name, schema in SCHEMAS.items()}
    )


def bodies(documents):
    found = {}
    for row in documents.orderBy("doc_id", "part_no").collect():
        found[row["doc_id"]] = found.get(row["doc_id"], "") + row["markdown"]
    return {key: text.split("---\n", 2)[2] for key, text in found.items()}


WANTED = {
    1: "\n" + QUICK + "\n\n# Imágenes extraídas\n\n![Figura 1](images/quick_image_001.png)"
    "\n![Figura 2](images/quick_image_003.png)\n",
    2: "\n# Página 1\n- item\n\n# two words\n\n| a | b |\n| --- | --- |\n| 1 | nan |\n\n"
    "![Figura](images/text_image_001.png)\n\n# Página 2\n\n"
    "> ⚠️ Página 2: error parcial al extraer bloques.\n",
    3: "\n# Página 1\n\nocr text\n\n![Página 1](images/scan_image_001.png)\n\n# Página 2\n\n"
    "> ⚠️ Página 2: no pudo rasterizarse. Contenido omitido.\n",
    4: "\n# Diapositiva 1\n\n![Figura](images/deck_image_001.png)\n\n## Head\n\n"
    "![Figura](images/deck_image_002.png)\n\nseen\n\n> **Notas:** say\n\n"
    "# Diapositiva 2\n\nbefore it broke\n\n> ⚠️ Diapositiva 2: error al procesar.\n",
    5: "\nphoto text\n\n![photo](images/photo_image_001.png)\n",
    6: "\n\n",
    8: "\n> ⚠️ OCR no produjo resultado para quick.png.\n",
    9: "\n# Página 1\n\n" + LONG + "\n\n# Página 2\n\nmore\n",
}


@pytest.mark.parametrize("limits", [{}, {"group_rows": 1, "part_chars": 5}], ids=["whole", "parts"])
def test_every_kind_of_file(tables, sliced, limits):
    options = Options(extract_images=True, generated_at="2024-01-01", **limits)
    documents, report = convert(tables, options)
    assert bodies(documents) == WANTED
    header = documents.where("doc_id = 1 and part_no = 0").first()["markdown"].split("\n")[:8]
    assert header == [
        "---",
        "source: quick.pdf",
        "pages: 1",
        "generated_at: 2024-01-01",
        "ocr_engine: markitdown",
        "markitdown_used: true",
        "languages: [es, en]",
        "---",
    ]
    rows = {row["file"]: tuple(row)[1:] for row in report.collect()}
    assert rows == {
        "quick.pdf": (1, "markitdown", "ok", "output/quick.md"),
        "text.pdf": (2, "tesseract", "ok", "output/text.md"),
        "scan.pdf": (2, "tesseract", "ok", "output/scan.md"),
        "deck.pptx": (2, "tesseract", "ok", "output/deck.md"),
        "photo.png": (1, "tesseract", "ok", "output/photo.md"),
        "broken.pdf": (0, "tesseract", "ok", "output/broken.md"),
        "note.txt": (0, "none", "error: Tipo de archivo no soportado: '.txt'", "—"),
        "quick.png": (1, "tesseract", "ok", "output/quick.md"),
        "long scan.pdf": (2, "tesseract", "ok", "output/long scan.md"),
    }
    routes = dict(documents.where("part_no = 0").select("doc_id", "route").collect())
    assert (routes[2], routes[3], routes[9]) == ("text_pdf", "scanned_pdf", "scanned_pdf")


def test_no_quick_tier_and_no_images(tables):
    documents, report = convert(tables, Options(use_quick=False, generated_at="2024-01-01"))
    found = bodies(documents)
    assert found[1] == "\n# Página 1\n" and "images/" not in "".join(found.values())
    assert {row["engine"] for row in report.collect()} == {"tesseract", "none"}


def test_unknown_engine_spares_quick_documents(tables):
    documents, report = convert(tables, Options(ocr_engine="other"))
    assert [row["doc_id"] for row in documents.collect()] == [1]
    assert report.where("status = 'ok'").count() == 1
    assert {row["engine"] for row in report.collect()} == {"markitdown", "none"}


@pytest.fixture
def without_broadcasts(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name in names:
        spark.conf.unset(name)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_are_chosen_before_the_gathering(tables, without_broadcasts):
    """Without broadcasts the joins to the plan deal the rows by document, and the gathering uses that."""
    documents, _ = convert(tables, Options(extract_images=True))
    assert bodies(documents) == WANTED
    _, found, below = plan_of(documents).partition("functions=[collect_list(struct(page_no")
    between = below.partition("Union")[0]
    assert found and "partial_collect_list" in between and "Exchange" not in between


@pytest.mark.parametrize("bitmap", [True, False])
def test_bitmaps_change_nothing(tables, sliced, bitmap):
    options = Options(extract_images=True, generated_at="2024-01-01", bitmap=bitmap)
    assert bodies(convert(tables, options).documents) == WANTED


def test_images_are_numbered_in_one_pass(tables, without_broadcasts):
    """One window gives the numbers of files and of labels, for all routes."""
    documents, _ = convert(tables, Options(extract_images=True, bitmap=False))
    windows = [line for line in plan_of(documents).split("\n") if re.search(r"\bWindow \[", line)]
    assert len(windows) == 2  # the other chooses between table extractors
    (numbers,) = [line for line in windows if "row_number()" in line]
    assert "sum(" in numbers
    plain, _ = convert(tables, Options(bitmap=False))
    assert "row_number()" not in plan_of(plain)


def test_bitmap_keeps_rows_from_the_shuffle(spark, without_broadcasts):
    """Of other routes' rows only the stated share enters the exchange; results are the same."""
    from foliomark.operators.idsets import IdBitmap, written

    ids = written(spark.range(0, 4_000, 2).withColumnRenamed("id", "doc_id"), "ids")
    rows = spark.range(40_000).selectExpr("id % 8000 AS doc_id", "id AS n").unionByName(spark.createDataFrame([(None, 1)], "doc_id long, n long"))
    bitmap = IdBitmap.of(ids, "doc_id")
    passing, maybe = bitmap.split(rows)
    chosen, every = 10_000, 40_001
    entering = maybe.count()
    assert passing.count() + entering == every
    assert chosen <= entering <= chosen + 1.3 * bitmap.wrong_share * (every - chosen)
    assert bitmap.only(rows).join(ids, "doc_id", "left_semi").count() == chosen
    assert passing.join(ids, "doc_id", "left_semi").count() == 0
    empty = IdBitmap.of(written(ids.limit(0), "ids"), "doc_id")
    assert empty.only(rows).count() == 0 and empty.wrong_share == 0


def test_fallback_with_and_without_bitmap(spark):
    from foliomark.operators.documents import tier_fallback

    vehicles = Vehicles(spark, SMALL)
    blocks, quick = vehicles.blocks().select("doc_id", "block_no"), vehicles.quick_text()
    plain, marked = (sorted(tier_fallback(blocks, quick, bitmap=on).collect()) for on in (False, True))
    assert plain == marked and plain


def test_stored_tables(spark, tables, tmp_path, without_broadcasts):
    """From the buckets to the gathered documents, no row of a usual document is shuffled."""
    from foliomark.plans.stored import convert_stored, open_tables, store_tables

    options = Options(extract_images=True, generated_at="2024-01-01")
    stored = store_tables(tables, f"{tmp_path}/decoded", "small", 3, options)
    documents, report = convert_stored(stored, options)
    assert bodies(documents) == WANTED and report.count() == len(ROWS["files"])
    plan = plan_of(documents)
    assert "collect_list(struct(page_no" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    for name in SCHEMAS:
        spark.sql(f"DROP TABLE small_{name}")  # files of such a table stay
    opened = open_tables(spark, f"{tmp_path}/decoded", "small", 3)
    again = convert_stored(opened, options).documents
    assert bodies(again) == WANTED and "Exchange" not in plan_of(again)
    assert bodies(convert_stored(opened, Options(use_quick=False, generated_at="2024-01-01")).documents)[1] == "\n# Página 1\n"


def test_stored_tables_are_not_sorted_again(spark, tables, tmp_path, without_broadcasts):
    """Buckets are written sorted; a join takes their rows, texts included, as they come."""
    from foliomark.plans.stored import convert_stored, store_tables

    options = Options(extract_images=True, generated_at="2024-01-01")
    documents, _ = convert_stored(store_tables(tables, f"{tmp_path}/decoded", "ordered", 3, options), options)
    plan = plan_of(documents)
    assert "SortMergeJoin" in plan
    assert not re.search(r"Sort \[doc_id#\d+L ASC NULLS FIRST\], false, 0\n(?:.*\b(?:Project|Filter|ColumnarToRow)\b.*\n)*.*FileScan", plan)
    assert bodies(documents) == WANTED


def test_stored_tables_with_large_documents(spark, tables, sliced, tmp_path):
    from foliomark.plans.stored import convert_stored, store_tables

    limits = Options(extract_images=True, generated_at="2024-01-01", group_rows=3, part_chars=60)
    stored = store_tables(tables, f"{tmp_path}/decoded", "cut", 2, limits)
    assert 0 < stored.large.number < len(ROWS["files"])
    documents, report = convert_stored(stored, limits)
    assert bodies(documents) == WANTED and report.count() == len(ROWS["files"])


@pytest.mark.parametrize("engine, text", [("paddle", "sure\nquite"), ("surya", "sure\nunsure\nquite")])
def test_lines_of_an_engine(spark, tables, engine, text):
    """Lines fill the pages that have no text yet; one engine leaves out what it isn't sure of."""
    from dataclasses import replace

    rows = [(8, 0, 2, "unsure", 0.5), (8, 0, 1, "sure", 0.9), (8, 0, 3, "quite", 0.6), (5, 0, 1, "not this", 0.9)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no int, line_no long, text string, confidence double")
    pages = tables.doc_pages.withColumn("ocr_text", F.when(F.col("doc_id") != 8, F.col("ocr_text")))
    documents, _ = convert(replace(tables, doc_pages=pages, ocr_lines=lines), Options(ocr_engine=engine))
    found = bodies(documents)
    assert found[8] == f"\n{text}\n" and found[5] == "\nphoto text\n"


def test_failed_files(spark, tables):
    """A failure of the second tier is the file's status, in its own words; quick files are spared."""
    from dataclasses import replace

    failed = tables.files.withColumn("error", F.when(F.col("doc_id") < 4, "engine not installed"))
    documents, report = convert(replace(tables, files=failed), Options())
    rows = {row["file"]: tuple(row)[1:] for row in report.collect()}
    assert rows["quick.pdf"] == (1, "markitdown", "ok", "output/quick.md")
    assert rows["scan.pdf"] == rows["text.pdf"] == (0, "none", "error: engine not installed", "—")
    assert {row["doc_id"] for row in documents.collect()} == {1, 4, 5, 6, 8, 9}


def test_stages_of_failure(spark, tables):
    """What fails after the second tier fails quick files, too; the row keeps engine and pages as far as they got."""
    from dataclasses import replace

    stages = {1: ("write", "disk full"), 2: ("count", "gone"), 3: (None, "no codec"), 4: ("write", "disk full"), 5: ("worker", "killed"), 7: ("write", "x")}
    rows = [(i, *stages.get(i, (None, None))) for i in range(1, 10)]
    failed = tables.files.join(spark.createDataFrame(rows, "doc_id long, error_stage string, error string"), "doc_id")
    documents, report = convert(replace(tables, files=failed), Options(ocr_engine="surya"))
    found = {row["file"]: tuple(row)[1:] for row in report.collect()}
    assert found["quick.pdf"] == (1, "markitdown", "error: disk full", "—")
    assert found["text.pdf"] == (0, "surya", "error: gone", "—")
    assert found["scan.pdf"] == (0, "none", "error: no codec", "—")
    assert found["deck.pptx"] == (2, "surya", "error: disk full", "—")
    assert found["photo.png"] == (0, "surya", "error: killed", "—")
    assert found["note.txt"] == (0, "none", "error: Tipo de archivo no soportado: '.txt'", "—")
    assert {row["doc_id"] for row in documents.collect()} == {6, 8, 9}


def test_figures_come_with_the_writing(tables, tmp_path):
    from foliomark.operators.report import report_figures

    _, report = convert(tables, Options())
    observed, figures = report_figures(report)
    observed.write.parquet(f"{tmp_path}/report")
    rows = report.collect()
    assert figures.get == {
        "files": 9, "ok": 8, "failed": 1, "pages": sum(r["pages"] for r in rows), "quick": sum(r["engine"] == "markitdown" for r in rows),
    }


def test_long_pages_in_parts(spark, sliced):
    """A page's OCR text that comes in parts is one page, in order, for everything that reads it."""
    vehicles = Vehicles(spark, SMALL)
    options = Options(ocr_engine="paddle", extract_images=True, generated_at="2024-01-01")
    parts = vehicles.image_pages(group_rows=3, part_chars=30)
    assert parts.where("part_no > 0").count() > 0
    counts = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("part_no").alias("last"))
    assert counts.where("n <> last + 1").count() == 0
    corpus = vehicles.corpus(["users"])
    cut = DocumentTables(**{
        name: parts.withColumn("doc_id", F.col("doc_id") * 5 + 4) if name == "doc_pages" else getattr(corpus, name)
        for name in SCHEMAS
    })
    whole, wanted = convert(corpus, options)
    found, report = convert(cut, options)
    assert bodies(found) == bodies(whole)
    assert sorted(report.collect()) == sorted(wanted.collect())


def test_given_corpus_in_parts(spark, sliced):
    corpus = Vehicles(spark, SMALL).corpus()
    assert corpus.ocr_lines is not None
    whole, _ = convert(corpus, Options(extract_images=True, generated_at="2024-01-01"))
    parts, _ = convert(
        corpus,
        Options(extract_images=True, generated_at="2024-01-01", group_rows=12, part_chars=200),
    )
    assert bodies(parts) == bodies(whole)
    assert parts.where(F.col("part_no") > 0).count() > 0


def test_folder(spark, tmp_path):
    """Listed, decoded, converted and written in one go; nothing is left in the shared folder."""
    from foliomark.plans.folder import convert_folder

    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (tmp_path / "in" / name).write_text(name)
    none = {name: spark.createDataFrame([], kind.replace("doc_id long", "doc_id string")) for name, kind in SCHEMAS.items()}

    def decoded(files):
        text = F.when(F.col("path").endswith("a.pdf"), QUICK)
        return DocumentTables(**none | {"quick_text": files.select("doc_id", text.alias("text"))})

    convert_folder(spark, str(tmp_path / "in"), decoded, str(tmp_path / "out"), Options(generated_at="2024-01-01"))
    found = bodies(spark.read.parquet(f"{tmp_path}/out/documents").withColumn("doc_id", F.col("file")))
    assert found == {"a.pdf": f"\n{QUICK}\n", "b.pdf": "\n\n"}
    assert spark.read.parquet(f"{tmp_path}/out/report").count() == 2


def test_sinks(spark, tables, tmp_path):
    documents, _ = convert(tables, Options(generated_at="2024-01-01"))
    documents = documents.where("doc_id < 8")
    wanted = {row["output"]: row["markdown"] for row in documents.collect()}
    sinks.write_table(documents, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == len(wanted)
    sizes = sinks.write_markdown_files(documents, f"{tmp_path}/files")
    for name, text in wanted.items():
        assert (tmp_path / "files" / name.split("/")[1]).read_text(encoding="utf-8") == text
    assert sizes.count() == len(wanted)
    sinks.write_text_folders(documents, f"{tmp_path}/folders")
    folder = tmp_path / "folders" / "output_name=text.md" / "part_no=0"
    (file,) = folder.glob("part-*")
    assert file.read_text(encoding="utf-8") == wanted["output/text.md"]
