"""From blocks to documents: routes, counts, bodies and headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import text as t
from ..functions import wording as w
from .blocks import IMAGES, ORDER, block, emit
from .gates import drop_blank_blocks, quick_sufficient
from .idsets import IdBitmap, broadcastable, written
from .parts import PART_CHARS, Texts, clean_body, ordered_text
from .skew import LargeGroups, find_large_groups, join_per_group

QUICK, TEXT_PDF, SCANNED_PDF, SLIDES, IMAGE = "quick", "text_pdf", "scanned_pdf", "slides", "image"


def page_count(pages: DataFrame) -> DataFrame:
    """Pages or slides per document; counted map-side first, a page in parts once."""
    if "part_no" in pages.columns:
        pages = pages.where(F.col("part_no") == 0)
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


def attach_counts(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Page count per file: 0 where nothing could be read, 1 for an image."""
    joined = files.join(counts, "doc_id", "left")
    pages = F.when(F.col("kind") == "image", 1).otherwise(F.coalesce("pages", F.lit(0)))
    return joined.withColumn("pages", pages.cast("int"))


def tier_fallback(
    blocks: DataFrame,
    quick_text: DataFrame,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    bitmap: bool | None = None,
) -> DataFrame:
    """Blocks of the documents whose quick text is missing or not sufficient.

    The ids of sufficient texts are written once.  If they are too many for a broadcast, a bitmap of them lets
    the blocks of other documents pass without a shuffle; only blocks whose document may be among them (those
    that are, and a share of others that `IdBitmap` states) go through the exact anti-join.  ``bitmap`` decides
    instead of the size.
    """
    done = written(quick_text.where(quick_sufficient(F.col("text"))).select("doc_id"), "sufficient")
    if bitmap if bitmap is not None else not broadcastable(done):
        passing, rest = IdBitmap.of(done, "doc_id").split(blocks)
        return passing.unionByName(join_per_group(rest, done, ["doc_id"], "left_anti", large, group_rows))
    return join_per_group(blocks, done, ["doc_id"], "left_anti", large, group_rows)


def route(use_quick: bool = True) -> Column:
    """Which path a file takes, from ``kind, sufficient, has_text``; null if unsupported."""
    quick = F.lit(use_quick) & (F.col("kind") != "image") & F.col("sufficient")
    return (
        F.when(quick, QUICK)
        .when((F.col("kind") == "pdf") & F.coalesce("has_text", F.lit(False)), TEXT_PDF)
        .when(F.col("kind") == "pdf", SCANNED_PDF)
        .when(F.col("kind") == "pptx", SLIDES)
        .when(F.col("kind") == "image", IMAGE)
    )


def engine_known(ocr_engine: str) -> bool:
    return ocr_engine in w.OCR_ENGINES


def engine_label(ocr_engine: str, stage: Column | None = None) -> Column:
    """The quick converter, or the OCR engine *asked for*, even where no OCR was needed.

    A file that fails in the second tier has none; one that fails later keeps its engine, and one whose
    worker died is booked on the engine asked for.
    """
    second = ocr_engine if engine_known(ocr_engine) else w.NO_ENGINE
    given = F.lit(w.CONVERT) if stage is None else F.coalesce(stage, F.lit(w.CONVERT))
    stage = F.when(F.col("error").isNotNull(), given)
    return (
        F.when(F.coalesce(stage == w.WORKER, F.lit(False)), ocr_engine)
        .when(F.col("route").isNull(), w.NO_ENGINE)
        .when(F.col("route") == QUICK, w.QUICK_ENGINE)
        .when(F.coalesce(stage == w.CONVERT, F.lit(False)), w.NO_ENGINE)
        .otherwise(second)
    )


def image_section_link() -> Column:
    label = F.concat(F.lit(w.FIGURE_LABEL + " "), F.col("figure").cast("string"))
    return n.image_link(label, F.col("image_name"))


def image_section_blocks(figures: DataFrame) -> DataFrame:
    """The same section as block rows, one per link, so that it needs no grouping of its own.

    It is a document's last block, so the line break at its end is stripped anyway.
    """
    return emit(figures, image_section_block())


def image_section_block() -> Column:
    before, _, _ = w.IMAGE_SECTION.partition("{links}")
    link, first = image_section_link(), F.col("figure") == 1
    md = F.when(first, F.concat(F.lit(before), link)).otherwise(link)
    return block(IMAGES, md, k3=F.col("figure"), same_block=~first)


def attach_image_section(
    docs: DataFrame,
    figures: DataFrame,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Add ``image_section``: a heading and one link per saved image; null without images."""
    links = ordered_text(
        figures.withColumn("_link", image_section_link()),
        ["doc_id"],
        ["figure"],
        "_link",
        "\n",
        "_links",
        large,
        group_rows,
        part_chars,
    )
    links = links.with_last_part(["doc_id"])
    before, _, after = w.IMAGE_SECTION.partition("{links}")
    part_no = F.coalesce("part_no", F.lit(0).cast("bigint"))
    section = F.concat(
        F.when(part_no == 0, before).otherwise(""),
        F.col("_links"),
        F.when(F.coalesce("last_part", F.lit(True)), after).otherwise(""),
    )
    return links.left_join(docs, ["doc_id"]).select(
        *docs.columns, part_no.alias("part_no"), section.alias("image_section")
    )


def join_ocr_lines(
    ocr_lines: DataFrame,
    confident_only: bool = False,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Text of each page from its OCR lines.

    With ``confident_only``, lines without enough confidence are left out; a page
    that has only such lines keeps its row, with empty text.
    """
    if confident_only:
        shaky = F.col("confidence") <= w.OCR_MIN_CONFIDENCE
        # a null text is skipped by the join below, its page is not
        ocr_lines = ocr_lines.withColumn("text", F.when(~shaky, F.col("text")))
    return ordered_text(
        ocr_lines,
        ["doc_id", "page_no"],
        ["line_no"],
        "text",
        "\n",
        "text",
        large,
        group_rows,
        part_chars,
    ).union()


def assemble_body(
    blocks: DataFrame,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``doc_id, part_no, body``: non-blank blocks in order, a blank line between, not cleaned."""
    if large is None:
        # counted before blank blocks are looked for
        large = find_large_groups(blocks, ["doc_id"], group_rows, F.length("md"), part_chars)
    return ordered_text(
        drop_blank_blocks(blocks),
        ["doc_id"],
        ORDER,
        "md",
        "\n\n",
        "body",
        large,
        group_rows,
        part_chars,
    ).union()


def document_bodies(
    blocks: DataFrame,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    part_chars: int = PART_CHARS,
) -> Texts:
    """``doc_id, part_no, last_part, body``: joined and cleaned."""
    if large is None:
        large = find_large_groups(blocks, ["doc_id"], group_rows, F.length("md"), part_chars)
    return clean_body(
        drop_blank_blocks(blocks),
        ["doc_id"],
        ORDER,
        "md",
        "body",
        large,
        group_rows,
        part_chars,
    )


def header(generated_at: Column, languages: Column) -> Column:
    """Header from the document columns ``file, pages, engine, quick_used``."""
    return t.front_matter(
        F.col("file"),
        F.col("pages"),
        generated_at,
        F.col("engine"),
        F.col("quick_used"),
        languages,
    )


def format_document(
    docs: DataFrame,
    bodies: Texts,
    generated_at: Column,
    languages: Column,
    keys: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Add ``part_no, markdown`` to every document, also to those without any block."""
    joined = bodies.left_join(docs, keys)
    part_no = F.coalesce("part_no", F.lit(0).cast("bigint"))
    first, last = part_no == 0, F.coalesce("last_part", F.lit(True))
    markdown = F.concat(
        F.when(first, F.concat(header(generated_at, languages), F.lit("\n\n"))).otherwise(""),
        F.coalesce("body", F.lit("")),
        F.when(last, "\n").otherwise(""),
    )
    return joined.select(*docs.columns, part_no.alias("part_no"), markdown.alias("markdown"))
