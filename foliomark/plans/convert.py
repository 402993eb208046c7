"""The whole conversion: input files and their decoded tables to documents and a report."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import text as t
from ..functions import wording as w
from ..operators import blocks as b
from ..operators import documents as d
from ..operators import report as r
from ..operators.gates import drop_blank_blocks, page_facts, quick_sufficient
from ..operators.idsets import IdBitmap, broadcastable, written
from ..operators.order import number_images, with_image_names
from ..operators.parts import PART_CHARS, Texts, clean_parts, clean_whole
from ..operators.skew import GROUP_ROWS, LargeGroups, join_per_group
from ..operators.tables import cell_chars, table_lines, tables_md


@dataclass(frozen=True)
class DocumentTables:
    """Decoded input, keyed by ``doc_id`` (never null).

    =========== ==============================================================
    files       doc_id, path; maybe error: why the file failed, and error_stage: convert (the second
                tier, also if left out), count (of pages), write, or worker
    quick_text  doc_id, text; null if the quick conversion failed
    doc_pages   doc_id, page_no, embedded_text, ocr_text, rasterized, ocr_error,
                block_error, image_saved; pages of PDFs and, as page 0, image files.
                Embedded text decides between text and scan, OCR text is printed.
                Maybe part_no: a page's long OCR text in rows, as join_ocr_lines gives it
    blocks      doc_id, page_no, block_no, block_type, x0, y0, text
    table_rows  doc_id, page_no, table_no, extractor, row_no, cells
    slides      doc_id, page_no, error
    shapes      doc_id, page_no, shape_no, kind, name, top, left, paragraphs,
                rows, ocr_text, ocr_error, decoded, saved, error
    notes       doc_id, page_no, text
    image_refs  doc_id, page_no, image_no, decoded, saved
    ocr_lines   doc_id, page_no, line_no, text, confidence; may be left out.  What the
                engine read line by line on pages whose ocr_text is null
    =========== ==============================================================

    A file that could not be opened simply has no rows besides the one in ``files``.
    """

    files: DataFrame
    quick_text: DataFrame
    doc_pages: DataFrame
    blocks: DataFrame
    table_rows: DataFrame
    slides: DataFrame
    shapes: DataFrame
    notes: DataFrame
    image_refs: DataFrame
    ocr_lines: DataFrame | None = None

    def decoded(self) -> dict[str, DataFrame]:
        """Every given table but the file list."""
        tables = {field.name: getattr(self, field.name) for field in fields(self)}
        return {name: df for name, df in tables.items() if name != "files" and df is not None}

    def restricted(self, change) -> DocumentTables:
        """Apply ``change`` to every table but the file list."""
        return replace(self, **{name: change(df) for name, df in self.decoded().items()})

    def row_sizes(self) -> DataFrame:
        """``doc_id, _rows, _chars`` of every decoded row of the tables that the plan doesn't read anyway."""
        texts = dict.fromkeys(("blocks", "notes", "ocr_lines"), "text") | {"shapes": "ocr_text"}
        rows = []
        for name, df in self.decoded().items():
            if name in ("quick_text", "doc_pages"):
                continue
            chars = F.length(texts[name]) if name in texts else F.lit(0)
            chars = cell_chars() if name == "table_rows" else chars
            rows.append(df.select("doc_id", F.lit(1).alias("_rows"), F.coalesce(chars, F.lit(0)).alias("_chars")))
        return reduce(DataFrame.union, rows)


@dataclass(frozen=True)
class Options:
    languages: str = "es,en"
    ocr_engine: str = w.DEFAULT_OCR_ENGINE
    extract_images: bool = False
    use_quick: bool = True
    output_dir: str = "output"
    # date as text; today if left out
    generated_at: str | None = None
    # rows of one document that one task may gather, and characters per part beyond that
    group_rows: int | None = None
    part_chars: int = PART_CHARS
    # whether ids of routes are put into bitmaps; by their number if left out
    bitmap: bool | None = None

    def date(self) -> Column:
        if self.generated_at is None:
            return F.current_date()
        return F.to_date(F.lit(self.generated_at))

    def language_list(self) -> Column:
        return t.parse_languages(F.lit(self.languages))


class Conversion(NamedTuple):
    documents: DataFrame
    report: DataFrame


def typed_files(files: DataFrame, output_dir: str = "output") -> DataFrame:
    file = n.file_name(F.col("path"))

    def given(name: str) -> Column:
        return (F.col(name) if name in files.columns else F.lit(None).cast("string")).alias(name)

    return files.select(
        "doc_id",
        given("error"),
        given("error_stage"),
        file.alias("file"),
        n.file_type(file).alias("kind"),
        n.output_path(file, output_dir).alias("planned_output"),
    )


def pages_with_lines(tables: DocumentTables, options: Options) -> DocumentTables:
    """Put the lines that the engine read into the pages, by the engine's own rule for them.

    One engine leaves out lines it is not sure of.  A page's long text comes in parts.
    """
    if tables.ocr_lines is None:
        return tables
    sure = options.ocr_engine in w.SURE_LINES_ENGINES
    read = d.join_ocr_lines(
        tables.ocr_lines, sure, group_rows=options.group_rows, part_chars=options.part_chars
    ).withColumnRenamed("text", "_read")
    pages = b.in_parts(tables.doc_pages)
    bare = pages.where(F.col("ocr_text").isNull()).drop("part_no")
    filled = (
        bare.join(read, ["doc_id", "page_no"], "left")
        .withColumn("part_no", F.coalesce("part_no", F.lit(0).cast("bigint")))
        .withColumn("ocr_text", F.col("_read"))
        .select(pages.columns)
    )
    kept = pages.where(F.col("ocr_text").isNotNull())
    return replace(tables, doc_pages=kept.unionByName(filled), ocr_lines=None)


def plan_documents(tables: DocumentTables, options: Options, sizes: bool = False) -> DataFrame:
    """One row per file: ``doc_id, file, kind, route, pages, engine, quick_used, status, output``.

    With ``sizes`` also ``rows, chars`` of its decoded tables; lengths are taken where texts are looked at anyway.
    """
    files = typed_files(tables.files, options.output_dir)
    gate = quick_sufficient(F.col("text")) if options.use_quick else F.lit(False)
    quick = tables.quick_text.select("doc_id", gate.alias("sufficient"), F.coalesce(F.length("text"), F.lit(0)).alias("_quick_chars"))
    read = [F.count(F.lit(1)).alias("_page_rows"), F.sum(F.coalesce(F.length("ocr_text"), F.lit(0))).alias("_page_chars")]
    files = (
        files.join(quick, "doc_id", "left")
        .join(page_facts(tables.doc_pages, *(read if sizes else [])), "doc_id", "left")
        .join(d.page_count(tables.slides).withColumnRenamed("pages", "slides"), "doc_id", "left")
        .withColumn("sufficient", F.coalesce("sufficient", F.lit(False)))
        .withColumn("route", d.route(options.use_quick))
        .withColumn("status", r.file_status(options.ocr_engine, F.col("error_stage")))
    )
    measured = []
    if sizes:
        rest = tables.row_sizes().groupBy("doc_id").agg(F.sum("_rows").alias("_rows"), F.sum("_chars").alias("_chars"))
        files = files.join(rest, "doc_id", "left")
        total = lambda *names: sum((F.coalesce(name, F.lit(0)) for name in names), F.lit(0)).cast("bigint")
        has_quick = F.when(F.col("_quick_chars").isNotNull(), 1).otherwise(0)
        measured = [
            (total("_page_rows", "_rows") + has_quick).alias("rows"), total("_quick_chars", "_page_chars", "_chars").alias("chars"),
        ]
    ok = F.col("status") == w.STATUS_OK
    counted = (
        F.when(F.col("kind") == "image", 1)
        .when(F.col("kind") == "pdf", F.col("pages"))
        .when(F.col("kind") == "pptx", F.col("slides"))
    )
    return files.select(
        "doc_id",
        "file",
        "kind",
        "route",
        F.when(ok | r.failed_at(F.col("error_stage"), w.WRITE) & F.col("kind").isNotNull(), F.coalesce(counted, F.lit(0))).otherwise(0).cast("int").alias("pages"),
        d.engine_label(options.ocr_engine, F.col("error_stage")).alias("engine"),
        (F.coalesce("route", F.lit("")) == d.QUICK).alias("quick_used"),
        "status",
        F.when(ok, F.col("planned_output")).alias("output"),
        *measured,
    )


# The routes that a table's rows can be on.
ROUTES = {
    "quick_text": (d.QUICK,),
    "doc_pages": (d.TEXT_PDF, d.SCANNED_PDF, d.IMAGE),
    "blocks": (d.TEXT_PDF,),
    "table_rows": (d.TEXT_PDF,),
    "slides": (d.SLIDES,),
    "shapes": (d.SLIDES, d.QUICK),
    "notes": (d.SLIDES,),
    "image_refs": (d.TEXT_PDF, d.QUICK),
}


@dataclass(frozen=True)
class Chosen:
    """The documents that are written, by route, as a filter for decoded tables.

    A table meets the ids of its routes before anything is made of its rows: by broadcast if Spark finds the
    written list small enough, else in a join on ``doc_id``, whose partitioning all later groupings use again.
    Then ``bitmaps`` (one for each set of routes) keep most rows of other routes out of that join's shuffle.
    """

    docs: DataFrame
    large: LargeGroups
    bitmaps: dict[tuple[str, ...], IdBitmap]

    @staticmethod
    def of(docs: DataFrame, large: LargeGroups, bitmap: bool | None = None) -> Chosen:
        """``docs`` is the written plan.  ``bitmap`` decides on bitmaps instead of the number of documents."""
        docs = docs.where(F.col("output").isNotNull())
        numbers = {row["route"]: row["count"] for row in docs.groupBy("route").count().collect()}
        bitmaps = {}
        for routes in dict.fromkeys(ROUTES.values()):
            number = sum(numbers.get(name, 0) for name in routes)
            wanted = bitmap if bitmap is not None else not broadcastable(docs, number)
            if wanted and number < sum(numbers.values()):
                bitmaps[routes] = IdBitmap.of(docs.where(F.col("route").isin(*routes)).select("doc_id"), "doc_id", number)
        return Chosen(docs, large, bitmaps)

    def on(self, *routes: str) -> DataFrame:
        return self.docs.where(F.col("route").isin(*routes))

    def of_route(self, tables: DocumentTables, name: str, *more: str) -> DataFrame:
        """Rows of a table whose document takes a route that uses them, with ``more`` columns of the plan."""
        rows, routes = getattr(tables, name), ROUTES[name]
        if routes in self.bitmaps:
            rows = self.bitmaps[routes].only(rows)
        plan = self.on(*routes).select("doc_id", *(F.col(column).alias(f"plan_{column}") for column in more))
        return join_per_group(rows, plan, ["doc_id"], "inner" if more else "left_semi", self.large)


def named_images(tables: DocumentTables, chosen: Chosen, in_parts: bool) -> DataFrame:
    """All images that are shown somewhere, numbered and named: ``doc_id, plan_route, figure, image_name, ..``.

    Three lists of images become one; of each document one of them counts.  So one sort by document gives
    both numbers, the file's and the label's, for every route.
    """
    more = ("route", "kind", "file")
    on_slide = F.col("plan_route") == d.SLIDES

    def listed(rows: DataFrame, image_no: Column, top: Column = F.lit(0), left: Column = F.lit(0)) -> DataFrame:
        return rows.select(
            "doc_id",
            F.col("page_no").cast("int").alias("page_no"),
            *(number.cast("bigint").alias(name) for name, number in (("top", top), ("left", left), ("image_no", image_no))),
            "decoded",
            "saved",
            "plan_route",
            "plan_file",
        )

    refs = chosen.of_route(tables, "image_refs", *more).where(
        (F.col("plan_route") == d.TEXT_PDF) | (F.col("plan_kind") == "pdf")
    )
    scans = chosen.of_route(tables, "doc_pages", *more).where(F.col("plan_route") == d.SCANNED_PDF)
    pictures = chosen.of_route(tables, "shapes", *more).where(
        (F.col("kind") == "PICTURE") & (on_slide | (F.col("plan_kind") == "pptx"))
    ).withColumn("decoded", F.col("decoded") & (~on_slide | F.col("error").isNull()))
    frames = (
        listed(refs, F.col("image_no")),
        listed(b.page_images(scans, "plan_route", "plan_file"), F.col("image_no")),
        # a deck's own list is in the order of its shapes, slides go by position
        listed(pictures, F.col("shape_no"), *(F.when(on_slide, F.coalesce(side, F.lit(0))).otherwise(0) for side in ("top", "left"))),
    )
    order = ("page_no", "top", "left", "image_no")
    if in_parts:
        numbered = number_images(b.union(*frames), order, large=chosen.large, figures=True)
    else:
        numbered = number_images(b.union_dealt(*frames), order, large=chosen.large, figures=True, key=b.DEALT)
        numbered = numbered.withColumnRenamed(b.DEALT, "doc_id")
    return with_image_names(numbered, n.sanitize_name(n.stem(F.col("plan_file"))))


def document_blocks(
    tables: DocumentTables, chosen: Chosen, options: Options, in_parts: bool
) -> DataFrame:
    """Blocks of all documents, each from the tables of the route that it takes; unless ``in_parts``, dealt by DEALT.

    ``in_parts`` is for large documents: their tables stay one row per line.
    """
    images = None
    if options.extract_images:
        images = b.emit_by(
            named_images(tables, chosen, in_parts),
            F.col("plan_route"),
            {
                d.TEXT_PDF: [b.figure_link()],
                d.SCANNED_PDF: [b.page_link()],
                d.SLIDES: [b.picture_link()],
                d.QUICK: [d.image_section_block()],
            },
        )
    # one pass over the pages serves all routes that have some
    pages = b.emit_by(
        chosen.of_route(tables, "doc_pages", "route", "file").withColumnRenamed("plan_file", "file"),
        F.col("plan_route"),
        {
            d.TEXT_PDF: b.text_page(),
            d.SCANNED_PDF: b.scanned_page(),
            d.IMAGE: b.image_page(options.extract_images),
        },
    )
    table_rows = b.without_failed_pages(chosen.of_route(tables, "table_rows"), tables.doc_pages, by_document=not in_parts)
    if in_parts:
        page_tables = b.table_line_blocks(table_lines(table_rows, options.group_rows))
    else:
        page_tables = b.table_blocks(tables_md(table_rows, by=["doc_id"]))
    quick = chosen.of_route(tables, "quick_text").withColumn("page_no", F.lit(0))
    shapes = chosen.of_route(tables, "shapes", "route").where(F.col("plan_route") == d.SLIDES)
    shapes = shapes.withColumn("image_name", F.lit(None).cast("string"))
    together = b.union if in_parts else b.union_dealt
    return together(
        pages,
        images,
        b.as_blocks(quick, b.CONTENT, F.col("text")),
        b.text_block_rows(chosen.of_route(tables, "blocks")),
        page_tables,
        b.slide_blocks(chosen.of_route(tables, "slides"), shapes, chosen.of_route(tables, "notes"), not in_parts),
    )


def usual_bodies(tables: DocumentTables, chosen: Chosen, options: Options) -> DataFrame:
    """``doc_id, part_no, last_part, body`` of documents that one task can hold each.

    Rows meet the written list of documents table by table, before blocks are made of them (`Chosen`).  Blocks
    are then gathered by document: in one shuffle, or in none where those joins, or the tables' buckets, have
    dealt the rows by document already.
    """
    blocks = document_blocks(tables, replace(chosen, large=replace(chosen.large, number=0)), options, in_parts=False)
    return clean_whole(drop_blank_blocks(blocks), [b.DEALT], b.ORDER, "md").withColumnRenamed(b.DEALT, "doc_id")


def large_bodies(tables: DocumentTables, chosen: Chosen, options: Options) -> DataFrame:
    """The same of large documents, in parts."""
    blocks = document_blocks(tables, chosen, options, in_parts=True)
    return clean_parts(chosen.large, drop_blank_blocks(blocks), ["doc_id"], b.ORDER, "md", part_chars=options.part_chars)


def document_bodies(
    tables: DocumentTables, docs: DataFrame, options: Options, large: LargeGroups
) -> Texts:
    """Bodies of the documents that have any block."""
    chosen = Chosen.of(docs, large, options.bitmap)
    whole = usual_bodies(tables.restricted(large.without), chosen, options)
    if not large:
        return Texts(whole, None, large)
    theirs = replace(chosen, docs=large.only(chosen.docs), bitmaps={})
    return Texts(whole, large_bodies(tables.restricted(large.only), theirs, options), large)


def large_documents(docs: DataFrame, options: Options) -> LargeGroups:
    """Documents with too many rows or characters for one task, from the sizes in the written plan."""
    limit = GROUP_ROWS if options.group_rows is None else options.group_rows
    keys = docs.where((F.col("rows") > limit) | (F.col("chars") > options.part_chars))
    number, rows = keys.agg(F.count(F.lit(1)), F.sum("rows")).first()
    return LargeGroups(("doc_id",), keys.select("doc_id"), number, rows or 0)


def convert(tables: DocumentTables, options: Options = Options()) -> Conversion:
    """Documents (``.. part_no, markdown``) and the report (one row per file).

    The plan of each document - type, route, page count, size - is a narrow table that is
    written once; texts are then read once more for the documents.  A document is one
    row, unless it is so large that it comes in parts (see ``operators.parts``).
    """
    planned = written(plan_documents(tables, options, sizes=True), "document-plan")
    docs = planned.drop("rows", "chars")
    large = large_documents(planned, options)
    bodies = document_bodies(pages_with_lines(tables, options), docs, options, large)
    return formatted(docs, bodies, options)


def formatted(docs: DataFrame, bodies: Texts, options: Options) -> Conversion:
    readable = docs.where(F.col("output").isNotNull())
    documents = d.format_document(readable, bodies, options.date(), options.language_list())
    return Conversion(documents, r.run_report(docs))
