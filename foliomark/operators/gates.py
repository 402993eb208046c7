"""Gates and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import wording as w


def quick_sufficient(text: Column) -> Column:
    """Quick text is enough if, stripped, it is long and has several lines; null fails."""
    stripped = t.strip(text)
    enough = (F.length(stripped) > w.QUICK_MIN_CHARS) & (
        t.newline_count(stripped) > w.QUICK_MIN_NEWLINES
    )
    return F.coalesce(enough, F.lit(False))


def first_pages(doc_pages: DataFrame) -> DataFrame:
    """Pages looked at when telling text documents from scans; reaches the scan as a filter."""
    return doc_pages.where(F.col("page_no") < w.DETECTION_PAGES)


def _long_enough() -> Column:
    """Whether the first pages' joined text, stripped, is long, from each page's ``chars, lead, trail``.

    White space falls away before the first and after the last page that isn't blank.
    """
    slots = range(w.DETECTION_PAGES)
    chars, lead, trail = ([F.coalesce(f"_{name}{slot}", F.lit(0)) for slot in slots] for name in ("chars", "lead", "trail"))
    length = F.lit(0)
    for first in reversed(slots):
        inner = F.lit(0)
        for last in slots[first:]:
            inked = chars[last] > lead[last]
            inner = F.when(inked, sum(chars[first + 1 : last + 1], chars[first]) - lead[first] - trail[last]).otherwise(inner)
        length = F.when(chars[first] > lead[first], inner).otherwise(length)
    return length > w.EMBEDDED_MIN_CHARS


def page_facts(doc_pages: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, pages, has_text`` in one aggregation; ``more`` are aggregates to take along.

    Each of a document's first pages has a slot of its own for the lengths of its embedded text, so that pages can
    be combined in any order: nothing is gathered or sorted, and only numbers are shuffled.  A page that comes in
    parts (``part_no``) counts once; OCR text plays no role.
    """
    text = F.coalesce("embedded_text", F.lit(""))
    blanks = F.lit(w.WHITESPACE)
    first_part = F.col("part_no") == 0 if "part_no" in doc_pages.columns else F.lit(True)
    looked_at = F.when((F.col("page_no") < w.DETECTION_PAGES) & first_part, text)
    chars = F.length(looked_at)
    rows = doc_pages.withColumns({
        "_first_part": first_part,
        "_chars": chars,
        "_lead": chars - F.length(F.ltrim(looked_at, blanks)),
        "_trail": chars - F.length(F.rtrim(looked_at, blanks)),
    })
    slots = [
        F.max(F.when(F.col("page_no") == slot, F.col(f"_{name}"))).alias(f"_{name}{slot}")
        for slot in range(w.DETECTION_PAGES)
        for name in ("chars", "lead", "trail")
    ]
    found = rows.groupBy("doc_id").agg(F.count_if("_first_part").alias("pages"), *slots, *more)
    return found.withColumn("has_text", _long_enough()).drop(*(f"_{name}{slot}" for slot in range(w.DETECTION_PAGES) for name in ("chars", "lead", "trail")))


def has_embedded_text(doc_pages: DataFrame) -> DataFrame:
    return page_facts(first_pages(doc_pages)).select("doc_id", "has_text")


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Text blocks (type 0), stripped, without blank ones."""
    kept = blocks.where((F.col("block_type") == 0) & ~t.is_blank(F.col("text")))
    return kept.withColumn("text", t.strip(F.col("text")))


def drop_blank_blocks(blocks: DataFrame, text: str = "md") -> DataFrame:
    """Drop blocks that are blank once stripped; those kept stay as they are."""
    return blocks.where(~t.is_blank(F.col(text)))


def ocr_confident_lines(ocr_lines: DataFrame) -> DataFrame:
    return ocr_lines.where(F.col("confidence") > w.OCR_MIN_CONFIDENCE)
