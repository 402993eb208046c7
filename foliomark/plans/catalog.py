"""Registered queries: every operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import tables as tb
from ..functions import text as t
from ..functions import wording as w
from ..operators import blocks as b
from ..operators import documents as d
from ..operators import gates as g
from ..operators import order as o
from ..operators import report as r
from ..operators import tables as tab
from ..session import run_folder
from ..sources.corpus import distinct_sorted_paths, read_texts, scan_corpus, scan_one
from ..sources.sinks import write_files, write_markdown_files
from .convert import Options, convert, plan_documents, typed_files
from .stored import convert_stored, store_tables
from .vehicles import Vehicles

Query = Callable[[SparkSession, str], DataFrame]

DATE = "2024-01-01"
UNKNOWN_ENGINE = "it's"
BLOCK = ["doc_id", *b.ORDER, "md"]

_queries: dict[str, Query] = {}


def query(name: str):
    def register(build: Callable[[Vehicles], DataFrame]):
        _queries[name] = lambda spark, sf_dir: build(Vehicles(spark, sf_dir))
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def _date():
    return F.to_date(F.lit(DATE))


def _languages():
    return t.parse_languages(F.lit("es, en"))


def _named(v: Vehicles) -> DataFrame:
    """Files with name, type and planned output."""
    return typed_files(v.files())


def _stored_corpus(v: Vehicles) -> str:
    """The documents as files, one each, in a fresh folder that all executors share."""
    folder = run_folder(v.spark, "corpus")
    texts = v.files().join(v.quick_text(), "doc_id").select(F.col("path").alias("file"), "text")
    write_files(texts, folder)
    return folder


# --- sources and sinks ------------------------------------------------------------


@query("scan_corpus")
def _(v):
    return scan_corpus(v.spark, _stored_corpus(v), recursive=True).select("file", "kind", "length")


@query("scan_one")
def _(v):
    """The file with the greatest path, out of a corpus of all documents."""
    folder = _stored_corpus(v)
    last = v.files().agg(F.max("path")).first()[0]
    return scan_one(v.spark, f"{folder}/{last}").select("file", "kind", "length")


def _user_paths(v: Vehicles) -> DataFrame:
    user = F.col("user_id").cast("string")
    path = F.concat("event_type", F.lit("/User "), user, F.lit(".pdf"))
    return v.table("events").select(path.alias("path"))


@query("distinct_sorted_paths")
def _(v):
    return distinct_sorted_paths(_user_paths(v))


@query("write_documents")
def _(v):
    """All given documents through both tiers into files, and the files read back."""
    folder = run_folder(v.spark, "markdown")
    corpus = v.corpus(["documents"])
    options = Options(ocr_engine="paddle", extract_images=True, generated_at=DATE)
    write_markdown_files(convert(corpus, options).documents, folder)
    return read_texts(v.spark, folder, ".md").select("file", F.col("text").alias("markdown"))


@query("run_report")
def _(v):
    return r.run_report(plan_documents(v.corpus(), Options()))


# --- names ------------------------------------------------------------------------


@query("file_type")
def _(v):
    name = n.file_name(F.col("path"))
    return v.files().select(
        "doc_id", n.stem(name).alias("stem"), n.suffix(name).alias("suffix"),
        n.file_type(name).alias("kind"),
    )


@query("sanitize_name")
def _(v):
    raw = F.concat(F.lit(" ."), "url", F.lit(". "))
    return v.table("pages").select("page_id", n.sanitize_name(raw).alias("name"))


@query("output_path")
def _(v):
    return v.files().select(
        "doc_id", n.output_path(n.file_name(F.col("path")), "output/").alias("output")
    )


@query("image_name")
def _(v):
    prefix = n.sanitize_name(n.stem(n.file_name(F.col("path"))))
    return v.files().select(
        "doc_id",
        n.image_name(prefix, F.col("doc_id") * 37).alias("image_name"),
        n.image_name(F.lit(""), F.col("doc_id")).alias("bare_name"),
    )


@query("image_ref_md")
def _(v):
    file = n.file_name(F.col("path"))
    name = n.image_name(n.sanitize_name(n.stem(file)), F.lit(1))
    number = (F.col("doc_id") + 1).cast("string")
    return v.files().select(
        "doc_id",
        n.image_link(F.lit(w.FIGURE_LABEL), name).alias("figure_md"),
        n.image_link(F.concat(F.lit(w.FIGURE_LABEL + " "), number), name).alias("numbered_md"),
        n.image_link(t.fill(w.PAGE_LABEL, n=number), name).alias("page_md"),
        n.image_link(n.stem(file), name).alias("stem_md"),
    )


# --- gates and filters --------------------------------------------------------------


@query("quick_sufficient")
def _(v):
    return v.quick_text().select("doc_id", g.quick_sufficient(F.col("text")).alias("sufficient"))


@query("has_embedded_text")
def _(v):
    return g.has_embedded_text(v.corpus().doc_pages)


@query("first_pages")
def _(v):
    return g.first_pages(v.doc_pages()).select("doc_id", "page_no", "embedded_text", "ocr_text")


@query("text_blocks")
def _(v):
    return g.text_blocks(v.blocks()).select("doc_id", "page_no", "block_no", "text")


@query("drop_blank_blocks")
def _(v):
    return g.drop_blank_blocks(v.blocks(), "text").select("doc_id", "block_no", "text")


@query("ocr_confident_lines")
def _(v):
    return g.ocr_confident_lines(v.ocr_lines()).select("doc_id", "page_no", "line_no", "text")


@query("nonblank_paragraphs")
def _(v):
    kept = b.nonblank_paragraphs(F.col("paragraphs"))
    return v.shapes().select(
        "doc_id", "shape_no", F.posexplode(kept).alias("pos", "p")
    ).select("doc_id", "shape_no", "pos", F.col("p.level").alias("level"), F.col("p.text").alias("text"))


# --- dispatch and routes --------------------------------------------------------------


@query("paragraph_md")
def _(v):
    lines = b.paragraph_md(F.col("name"), F.col("paragraphs"))
    return v.shapes().select("doc_id", "shape_no", F.posexplode(lines).alias("pos", "md"))


def _shapes_with_image_names(v: Vehicles) -> DataFrame:
    """Image named after the shape number, where it was saved."""
    name = n.image_name(F.lit("Deck"), F.col("shape_no"))
    return v.shapes().withColumn("image_name", F.when(F.col("saved"), name))


@query("shape_dispatch")
def _(v):
    return b.shape_dispatch(_shapes_with_image_names(v)).select(BLOCK)


@query("tier_route")
def _(v):
    return plan_documents(v.corpus(), Options()).select("doc_id", "kind", "route")


@query("engine_label")
def _(v):
    return plan_documents(v.corpus(), Options(ocr_engine="paddle")).select("doc_id", "engine")


@query("tier_fallback")
def _(v):
    return d.tier_fallback(v.blocks(), v.quick_text()).select("doc_id", "block_no", "text")


# --- counts and sections --------------------------------------------------------------


@query("attach_counts")
def _(v):
    corpus = v.corpus()
    pages = corpus.doc_pages.where("part_no = 0").select("doc_id")
    counts = d.page_count(pages.union(corpus.slides.select("doc_id")))
    return d.attach_counts(typed_files(corpus.files), counts).select("doc_id", "kind", "pages")


@query("page_count")
def _(v):
    return d.page_count(v.corpus().doc_pages)


@query("slide_count")
def _(v):
    return d.page_count(v.slides()).withColumnRenamed("pages", "slides")


def _figures(v: Vehicles) -> DataFrame:
    return o.with_image_names(o.number_images(v.image_refs(), figures=True), F.lit("User"))


@query("attach_image_section")
def _(v):
    return d.attach_image_section(v.files().select("doc_id"), _figures(v))


@query("page_sections")
def _(v):
    return b.page_sections(v.doc_pages(), v.blocks(), w.PAGE_HEADING).select(BLOCK)


# --- tables ---------------------------------------------------------------------------


@query("nonempty_tables")
def _(v):
    return tab.nonempty_tables(v.table_rows()).select(*tab.TABLE, "n_rows", "width")


@query("table_extractor_fallback")
def _(v):
    return tab.table_extractor_fallback(v.table_rows()).select(*tab.TABLE, "n_rows", "width")


@query("table_md_padded")
def _(v):
    return v.shapes().select("doc_id", "shape_no", tb.table_md_padded(F.col("rows")).alias("md"))


@query("table_md_header_width")
def _(v):
    return v.shapes().select(
        "doc_id", "shape_no", tb.table_md_header_width(F.col("rows")).alias("md")
    )


@query("table_rows_to_md")
def _(v):
    return tab.page_tables_md(v.table_rows())


# --- order and numbers ----------------------------------------------------------------


@query("number_images")
def _(v):
    return o.number_images(v.image_refs()).select("doc_id", "page_no", "image_no", "image_number")


@query("number_figures")
def _(v):
    return _figures(v).select("doc_id", "image_no", "image_number", "figure", "image_name")


@query("slide_images")
def _(v):
    return o.slide_images(v.shapes())


@query("reading_order")
def _(v):
    return o.reading_order(v.blocks()).select(
        "doc_id", "page_no", "block_no", "row_band", "reading_pos"
    )


@query("shape_order")
def _(v):
    return o.shape_order(v.shapes()).select("doc_id", "page_no", "shape_no", "shape_pos")


# --- blocks ---------------------------------------------------------------------------


@query("pdf_page_blocks")
def _(v):
    images = o.with_image_names(o.number_images(v.image_refs()), F.lit("Doc"))
    rows = b.without_failed_pages(v.table_rows(), v.order_pages())
    tables = b.table_blocks(tab.page_tables_md(rows))
    return b.pdf_page_blocks(v.order_pages(), v.blocks(), tables, images).select(BLOCK)


def _scanned_blocks(v: Vehicles) -> DataFrame:
    pages = v.doc_pages()
    images = o.with_image_names(o.number_images(b.page_images(pages)), F.lit("Scan"))
    return b.scanned_page_blocks(pages, images)


@query("scanned_page_blocks")
def _(v):
    return _scanned_blocks(v).select(BLOCK)


@query("slide_blocks")
def _(v):
    return b.slide_blocks(v.slides(), _shapes_with_image_names(v), v.notes()).select(BLOCK)


def _image_pages(v: Vehicles) -> DataFrame:
    file = F.concat(F.lit("Photo? "), F.col("doc_id").cast("string"), F.lit(".png"))
    return v.image_pages().withColumn("file", file)


@query("image_doc_blocks")
def _(v):
    return b.image_doc_blocks(_image_pages(v), with_images=True).select(BLOCK)


@query("page_warnings")
def _(v):
    return b.page_warnings(v.doc_pages()).select(BLOCK)


@query("doc_warnings")
def _(v):
    return b.doc_warnings(_image_pages(v), v.slides()).select(BLOCK)


@query("join_ocr_lines")
def _(v):
    return d.join_ocr_lines(v.ocr_lines(), confident_only=True)


@query("assemble_body")
def _(v):
    return d.assemble_body(_scanned_blocks(v))


# --- report ---------------------------------------------------------------------------


def _failing_files(v: Vehicles) -> DataFrame:
    """The corpus' files, of which some failed: in the second tier, later, or with their worker."""
    return v.corpus().files.selectExpr(
        "doc_id",
        "path",
        "case when doc_id % 7 = 3 then concat('stopped at ', doc_id) end as error",
        "element_at(array('convert', 'write', 'count', 'worker', cast(null as string)), cast(doc_id % 5 as int) + 1) as error_stage",
    )


@query("file_status")
def _(v):
    """With failures of every stage, quick files included; with a known engine, and with an unknown one."""
    corpus = replace(v.corpus(), files=_failing_files(v))
    known = plan_documents(corpus, Options()).select("doc_id", "file", "engine", "pages", "status")
    other = plan_documents(corpus, Options(ocr_engine=UNKNOWN_ENGINE)).select(
        "doc_id", F.col("status").alias("status_unknown_engine")
    )
    return known.join(other, "doc_id")


@query("run_figures")
def _(v):
    """Files by status and engine, as the report's own figures have them while it is written."""
    report = r.run_report(plan_documents(replace(v.corpus(), files=_failing_files(v)), Options()))
    observed, figures = r.report_figures(report)
    observed.write.parquet(run_folder(v.spark, "report"))
    names = ["files", "ok", "failed", "pages", "quick"]
    return v.spark.createDataFrame([tuple(figures.get[name] for name in names)], ", ".join(f"{name} long" for name in names))


@query("unreadable_ok")
def _(v):
    """Files that no decoder of the second tier could open."""
    corpus = v.corpus(["documents"])
    unread = replace(corpus.restricted(lambda df: df.where(F.lit(False))), quick_text=corpus.quick_text)
    return convert(unread, Options(generated_at=DATE)).documents.select(
        "doc_id", "kind", "pages", "engine", "status", "part_no", "markdown"
    )


@query("output_collisions")
def _(v):
    """Same name in different folders."""
    paths = _user_paths(v).distinct().withColumn("doc_id", F.xxhash64("path"))
    return r.output_collisions(typed_files(paths).withColumnRenamed("planned_output", "output"))


# --- text -----------------------------------------------------------------------------


def _register_text(name: str, step) -> None:
    @query(name)
    def _(v):
        return v.dirty_text().select("doc_id", step(F.col("text")).alias("text"))


for _name, _step in {
    "remove_control": t.remove_control,
    "normalize_headers": t.normalize_headers,
    "normalize_lists": t.normalize_lists,
    "collapse_spaces": t.collapse_spaces,
    "limit_blank_lines": t.limit_blank_lines,
    "clean_markdown": t.clean_markdown,
}.items():
    _register_text(_name, _step)


def _requested_languages() -> Column:
    text = F.concat(F.lit(" "), F.upper("lang"), F.lit(" ,, "), "lang", F.lit(",JPN,"), "source")
    return t.parse_languages(text)


@query("parse_languages")
def _(v):
    found = _requested_languages()
    return v.table("documents").select(
        "doc_id",
        F.size(found).alias("n"),
        F.array_join(found, "|").alias("languages"),
        F.array_join(t.languages_or_default(t.parse_languages(F.lit(" , "))), "|").alias("default"),
    )


@query("ocr_language_codes")
def _(v):
    return v.table("documents").select(
        "doc_id", t.ocr_language_codes(_requested_languages()).alias("codes")
    )


@query("front_matter")
def _(v):
    used = g.quick_sufficient(F.col("text"))
    engine = F.when(used, w.QUICK_ENGINE).otherwise(w.DEFAULT_OCR_ENGINE)
    header = t.front_matter(
        n.file_name(F.col("path")), F.col("doc_id") % 10, _date(), engine, used, _languages()
    )
    texts = v.quick_text()
    return v.files().join(texts, "doc_id").select("doc_id", header.alias("header"))


@query("format_document")
def _(v):
    """One document per conversation, a page per turn."""
    pages = v.doc_pages()
    name = F.concat(F.lit("Scan "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    docs = d.page_count(pages).select(
        "doc_id",
        name.alias("file"),
        "pages",
        F.lit(w.DEFAULT_OCR_ENGINE).alias("engine"),
        F.lit(False).alias("quick_used"),
    )
    bodies = d.document_bodies(b.scanned_page_blocks(pages))
    return d.format_document(docs, bodies, _date(), _languages()).select(
        "doc_id", "part_no", "markdown"
    )


@query("convert_corpus")
def _(v):
    """The whole conversion, all five kinds of files, with images and the engine's lines."""
    options = Options(ocr_engine="paddle", extract_images=True, generated_at=DATE)
    return convert(v.corpus(), options).documents.select(
        "doc_id", "route", "pages", "engine", "output", "part_no", "markdown"
    )


@query("convert_stored")
def _(v):
    """The same from tables that are stored by document first."""
    options = Options(ocr_engine="paddle", extract_images=True, generated_at=DATE)
    folder = run_folder(v.spark, "decoded")
    name = f"decoded_{folder.rpartition('-')[2]}"
    buckets = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = store_tables(v.corpus(), folder, name, buckets, options)
    return convert_stored(stored, options).documents.select(
        "doc_id", "route", "pages", "engine", "output", "part_no", "markdown"
    )
