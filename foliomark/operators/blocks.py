"""Markdown blocks of pages, slides and image files.

Blocks share one schema, in which every list position is a column::

    doc_id, page_no, section, k1, k2, k3, k4, md, same_block

``section`` ranks the parts of a page; ``k1``..``k4`` order rows inside one.
Failures are columns of the input and become warning blocks, never exceptions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import tables as tb
from ..functions import text as t
from ..functions import wording as w
from .gates import text_blocks
from .order import row_band

HEADING, CONTENT, TABLES, NOTES, WARNING, IMAGES = range(6)
ORDER = ["page_no", "section", "k1", "k2", "k3", "k4"]
SCHEMA = ["doc_id", *ORDER, "md", "same_block"]


def block(
    section: int,
    md: Column,
    k1: Column | None = None,
    k2: Column | None = None,
    k3: Column | None = None,
    k4: Column | None = None,
    same_block: Column | None = None,
) -> Column:
    """One block of a row as a struct; a null ``md`` means there is none."""

    def key(column: Column | None, kind: str, name: str) -> Column:
        return (F.lit(0) if column is None else column).cast(kind).alias(name)

    return F.struct(
        F.lit(section).alias("section"),
        key(k1, "double", "k1"),
        key(k2, "double", "k2"),
        key(k3, "bigint", "k3"),
        key(k4, "bigint", "k4"),
        md.alias("md"),
        (F.lit(False) if same_block is None else same_block).alias("same_block"),
    )


def emit(df: DataFrame, *blocks: Column) -> DataFrame:
    """The blocks of every row, in one pass over ``df``."""
    rows = in_parts(df).select(
        "doc_id", F.col("page_no").cast("int").alias("page_no"), F.inline(F.array(*blocks))
    )
    return rows.where(F.col("md").isNotNull())


def emit_by(df: DataFrame, choice: Column, blocks: dict[str, list[Column]]) -> DataFrame:
    """The blocks of every row that its ``choice`` names, in one pass; other blocks aren't worked out."""
    found = None
    for name, own in blocks.items():
        found = (F if found is None else found).when(choice == name, F.array(*own))
    rows = in_parts(df).select("doc_id", F.col("page_no").cast("int").alias("page_no"), F.inline(found))
    return rows.where(F.col("md").isNotNull())


def in_parts(pages: DataFrame) -> DataFrame:
    """Pages with ``part_no``: 0, unless a page's long OCR text comes in several rows."""
    if "part_no" in pages.columns:
        return pages
    return pages.withColumn("part_no", F.lit(0).cast("bigint"))


def once(value: Column) -> Column:
    """What a page has besides its text stands with the first part only."""
    return F.when(F.col("part_no") == 0, value)


def after_break(text: str) -> Column:
    """A later part of a text without the line break that it begins with."""
    return F.regexp_replace(text, r"\A\n", "")


def as_blocks(df: DataFrame, section: int, md: Column, **keys: Column) -> DataFrame:
    return emit(df, block(section, md, **keys))


def union(*frames: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, [frame for frame in frames if frame is not None])


# What a document's id is called in a union that is dealt by document.
DEALT = "document"


def union_dealt(*frames: DataFrame | None) -> DataFrame:
    """A union that is still dealt by document if its frames are; the id is then called DEALT.

    Spark compares the columns that frames are dealt by as they come out of each.  A join has found out that its
    key is never null, which its input's dealing doesn't say; under a new name both are the same column again.
    """
    return union(*(None if frame is None else frame.withColumnRenamed("doc_id", DEALT) for frame in frames))


def shown_number() -> Column:
    """Pages are stored from 0 and shown from 1."""
    return F.col("page_no") + 1


# --- headings ---------------------------------------------------------------------


def heading(template: str) -> Column:
    return block(HEADING, once(t.fill(template, n=shown_number())))


def page_sections(pages: DataFrame, content: DataFrame, template: str) -> DataFrame:
    """A heading for every page that is listed or has content; empty pages keep theirs."""
    every = pages.select("doc_id", "page_no").union(content.select("doc_id", "page_no"))
    return emit(every.distinct(), heading(template))


# --- text PDFs --------------------------------------------------------------------


def text_block_rows(blocks: DataFrame) -> DataFrame:
    kept = text_blocks(blocks)
    return as_blocks(
        kept,
        CONTENT,
        F.col("text"),
        k1=row_band(F.col("y0")),
        k2=F.col("x0"),
        k3=F.col("block_no"),
    )


def table_blocks(page_tables: DataFrame) -> DataFrame:
    """Tables as blocks; a later part carries on the block before it, a line below."""
    later = F.col("_table_part") > 0
    md = F.when(later, after_break("md")).otherwise(F.col("md"))
    return emit(
        page_tables.withColumnRenamed("part_no", "_table_part"),
        block(TABLES, md, k3=F.col("table_no"), k4=F.col("_table_part"), same_block=later),
    )


def table_line_blocks(lines: DataFrame) -> DataFrame:
    """Tables line by line, for documents that are put together in parts."""
    return as_blocks(
        lines,
        TABLES,
        F.col("md"),
        k3=F.col("table_no"),
        k4=F.col("row_no"),
        same_block=F.col("row_no") != F.col("header_no"),
    )


def own_line(md: Column) -> Column:
    return F.concat(F.lit("\n"), md, F.lit("\n"))


def figure_link() -> Column:
    link = n.image_link(F.lit(w.FIGURE_LABEL), F.col("image_name"))
    return block(IMAGES, own_line(link), k3=F.col("image_no"))


def figure_links(named_images: DataFrame) -> DataFrame:
    return emit(named_images, figure_link())


def picture_link() -> Column:
    """Link of a slide's picture, from ``top, left, image_no``; it stands before what OCR read in the picture."""
    link = n.image_link(F.lit(w.FIGURE_LABEL), F.col("image_name"))
    return block(
        CONTENT, own_line(link), k1=F.col("top"), k2=F.col("left"), k3=F.col("image_no"), k4=F.lit(-1)
    )


def partial_error() -> Column:
    """Text blocks found before the failure stay, tables come after it and are lost."""
    return once(F.when(F.col("block_error"), t.fill(w.PAGE_PARTIAL_ERROR, n=shown_number())))


def text_page() -> list[Column]:
    """What a page of a text PDF has besides its blocks: heading and, maybe, a warning."""
    return [heading(w.PAGE_HEADING), block(WARNING, partial_error())]


def but_pages(rows: DataFrame, failed: DataFrame, by_document: bool = False) -> DataFrame:
    """Rows without those of the ``failed`` pages (``doc_id, page_no``).

    An anti-join on page keys; Spark may split a page with very many rows.  ``by_document`` is for documents of
    bounded size: their failed pages come as one list, so that rows that are dealt by document stay where they are.
    """
    if not by_document:
        return rows.join(failed, ["doc_id", "page_no"], "left_anti")
    lists = failed.groupBy("doc_id").agg(F.collect_set("page_no").alias("_failed"))
    spared = ~F.coalesce(F.array_contains("_failed", F.col("page_no")), F.lit(False))
    return rows.join(lists, "doc_id", "left").where(spared).drop("_failed")


def without_failed_pages(rows: DataFrame, doc_pages: DataFrame, by_document: bool = False) -> DataFrame:
    """Drop what comes after the text blocks of a page on which these failed."""
    return but_pages(rows, doc_pages.where(F.col("block_error")).select("doc_id", "page_no"), by_document)


def pdf_page_blocks(
    doc_pages: DataFrame,
    blocks: DataFrame,
    tables: DataFrame | None = None,
    images: DataFrame | None = None,
) -> DataFrame:
    """Per page: heading, text blocks in reading order, tables, then images.

    ``tables`` are blocks (``table_blocks``, ``table_line_blocks``) of pages without error.
    """
    return union(
        emit(doc_pages, *text_page()),
        text_block_rows(blocks),
        tables,
        None if images is None else figure_links(images),
    )


# --- scanned PDFs -----------------------------------------------------------------


def is_empty(text: Column) -> Column:
    return t.is_blank(F.coalesce(text, F.lit("")))


def scanned_page_warning() -> Column:
    """The warning that stands for the text: not rasterised, OCR failed, or OCR empty."""
    page = shown_number()
    return once(
        F.when(~F.col("rasterized"), t.fill(w.PAGE_NOT_RASTERIZED, n=page))
        .when(F.col("ocr_error").isNotNull(), t.fill(w.PAGE_OCR_FAILED, n=page))
        .when(is_empty(F.col("ocr_text")), t.fill(w.PAGE_OCR_EMPTY, n=page))
    )


def read_text(warning: Column) -> Column:
    """OCR text or the warning that stands for it; later parts carry on a line below."""
    later = F.col("part_no") > 0
    was_read = F.col("rasterized") & F.col("ocr_error").isNull()
    text = F.when(was_read, F.when(later, after_break("ocr_text")).otherwise(F.col("ocr_text")))
    return block(CONTENT, F.coalesce(warning, text), k4=F.col("part_no"), same_block=later)


def scanned_page() -> list[Column]:
    """Heading, then OCR text or its warning."""
    return [heading(w.PAGE_HEADING), read_text(scanned_page_warning())]


def page_images(doc_pages: DataFrame, *more: str) -> DataFrame:
    """Image references of scanned pages: one for each page that went through OCR; ``more`` columns are kept."""
    read = in_parts(doc_pages).where(
        F.col("rasterized") & F.col("ocr_error").isNull() & (F.col("part_no") == 0)
    )
    return read.select(
        "doc_id",
        "page_no",
        F.lit(0).cast("bigint").alias("image_no"),
        F.lit(True).alias("decoded"),
        F.col("image_saved").alias("saved"),
        *more,
    )


def page_link() -> Column:
    label = t.fill(w.PAGE_LABEL, n=shown_number())
    return block(IMAGES, own_line(n.image_link(label, F.col("image_name"))))


def page_links(named_images: DataFrame) -> DataFrame:
    return emit(named_images, page_link())


def scanned_page_blocks(doc_pages: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per page: heading, OCR text or a warning, then the page image."""
    return union(
        emit(doc_pages, *scanned_page()), None if images is None else page_links(images)
    )


def page_warnings(doc_pages: DataFrame) -> DataFrame:
    """Warning blocks of scanned pages and of pages with a partial block error."""
    return emit(
        doc_pages, block(CONTENT, scanned_page_warning()), block(WARNING, partial_error())
    )


# --- slides -----------------------------------------------------------------------


def nonblank_paragraphs(paragraphs: Column) -> Column:
    return F.transform(
        F.filter(paragraphs, lambda p: ~t.is_blank(p["text"])),
        lambda p: F.struct(p["level"].alias("level"), t.strip(p["text"]).alias("text")),
    )


def is_title(name: Column) -> Column:
    lowered = F.lower(name)
    return reduce(Column.__or__, [F.contains(lowered, F.lit(word)) for word in w.TITLE_WORDS])


def paragraph_md(name: Column, paragraphs: Column) -> Column:
    """Lines of a text frame: title heading, indented list item, or plain text."""
    title = F.coalesce(is_title(name), F.lit(False))

    def line(p: Column) -> Column:
        level, text = p["level"], p["text"]
        return (
            F.when(title & (level == 0), t.fill(w.TITLE_PARAGRAPH, text=text))
            .when(level > 0, F.concat(F.repeat(F.lit("  "), level - 1), F.lit("- "), text))
            .otherwise(text)
        )

    return F.transform(nonblank_paragraphs(paragraphs), line)


def shape_md() -> Column:
    """Blocks of one shape as an array, by its kind; other kinds and failed shapes give none.

    A picture gives its link, if it was saved (``image_name``), then its OCR text.  One
    that cannot be decoded gives nothing, one that OCR failed on (``ocr_error``) keeps
    its link, and blank OCR is no warning.
    """
    link = n.image_link(F.lit(w.FIGURE_LABEL), F.col("image_name"))
    picture = F.array(F.concat(F.lit("\n"), link, F.lit("\n")), F.when(F.col("ocr_error").isNull(), F.col("ocr_text")))
    table = F.array(tb.table_md_header_width(F.col("rows")))
    none = F.array().cast("array<string>")
    found = (
        F.when(F.col("error").isNotNull(), none)
        .when(F.col("kind") == "TABLE", table)
        .when((F.col("kind") == "PICTURE") & F.col("decoded"), picture)
        .when(F.col("kind") == "TEXT", paragraph_md(F.col("name"), F.col("paragraphs")))
        .otherwise(none)
    )
    return F.filter(found, lambda md: md.isNotNull() & ~t.is_blank(md))


def shape_dispatch(shapes: DataFrame) -> DataFrame:
    """Shape blocks in position order; several blocks of a shape keep their order."""
    placed = shapes.select(
        "doc_id", "page_no", "top", "left", "shape_no", F.posexplode(shape_md()).alias("pos", "md")
    )
    return as_blocks(
        placed,
        CONTENT,
        F.col("md"),
        k1=F.coalesce("top", F.lit(0)),
        k2=F.coalesce("left", F.lit(0)),
        k3=F.col("shape_no"),
        k4=F.col("pos"),
    )


def notes_blocks(notes: DataFrame) -> DataFrame:
    kept = notes.where(~t.is_blank(F.col("text")))
    return as_blocks(kept, NOTES, t.fill(w.NOTES_BLOCK, text=t.strip(F.col("text"))))


def slide_failed() -> Column:
    return F.when(F.col("error").isNotNull(), t.fill(w.SLIDE_FAILED, n=shown_number()))


def slide_blocks(slides: DataFrame, shapes: DataFrame, notes: DataFrame, by_document: bool = False) -> DataFrame:
    """Per slide: heading, shapes by position, then speaker notes; a warning if it failed.

    Notes are read last, so a slide that failed has none.  ``shapes`` needs
    ``image_name``; null where no image was saved.  ``by_document``: see `but_pages`.
    """
    failed = slides.where(F.col("error").isNotNull()).select("doc_id", "page_no")
    return union(
        emit(slides, heading(w.SLIDE_HEADING), block(WARNING, slide_failed())),
        shape_dispatch(shapes),
        notes_blocks(but_pages(notes, failed, by_document)),
    )


# --- image files ------------------------------------------------------------------


def image_warning() -> Column:
    failed = F.col("ocr_error").isNotNull()
    error = t.fill(w.IMAGE_OCR_FAILED, error=F.coalesce("ocr_error", F.lit("")))
    empty = t.fill(w.IMAGE_OCR_EMPTY, name=F.col("file"))
    return once(F.when(failed, error).when(is_empty(F.col("ocr_text")), empty))


def image_doc_blocks(image_pages: DataFrame, with_images: bool = False) -> DataFrame:
    """OCR text or a warning, then, if saved, a link labelled with the file stem.

    ``image_pages`` has one row per image file that could be opened, with ``file``.
    """
    return emit(image_pages, *image_page(with_images))


def image_page(with_images: bool = False) -> list[Column]:
    blocks = [read_text(image_warning())]
    if with_images:
        stem = n.stem(F.col("file"))
        link = n.image_link(stem, n.image_name(n.sanitize_name(stem), F.lit(1)))
        blocks.append(block(IMAGES, once(F.when(F.col("image_saved"), own_line(link)))))
    return blocks


def doc_warnings(image_pages: DataFrame, slides: DataFrame) -> DataFrame:
    """Warnings of image files (OCR failed or empty) and of failed slides."""
    return union(
        as_blocks(image_pages, CONTENT, image_warning()),
        as_blocks(slides, WARNING, slide_failed()),
    )
