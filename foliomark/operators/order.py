"""Reading order, shape order and image numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as n
from .skew import LargeGroups, number_rows


def row_band(y0: Column) -> Column:
    """Row of a block: y0 to the nearest 20, halves to the even band (10, 30, 50 to 0, 40, 40)."""
    return F.bround(y0 / F.lit(20.0)) * F.lit(20.0)


def reading_order(
    blocks: DataFrame, large: LargeGroups | None = None, group_rows: int | None = None
) -> DataFrame:
    """Add ``reading_pos``, the 1-based place on the page: by row band, x0, then block number."""
    return number_rows(
        blocks.withColumn("row_band", row_band(F.col("y0"))),
        ["doc_id", "page_no"],
        ["row_band", "x0", "block_no"],
        "reading_pos",
        large,
        group_rows,
    )


def shape_order(
    shapes: DataFrame, large: LargeGroups | None = None, group_rows: int | None = None
) -> DataFrame:
    """Add ``shape_pos``: by top, then left; a missing position counts as 0."""
    placed = shapes.withColumn("_top", F.coalesce("top", F.lit(0))).withColumn(
        "_left", F.coalesce("left", F.lit(0))
    )
    return number_rows(
        placed, ["doc_id", "page_no"], ["_top", "_left", "shape_no"], "shape_pos", large, group_rows
    ).drop("_top", "_left")


def number_images(
    image_refs: DataFrame,
    order: tuple[str, ...] = ("page_no", "image_no"),
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    figures: bool = False,
    key: str = "doc_id",
) -> DataFrame:
    """Saved images with their number in the document.

    An image takes its number before it is saved, so a failed save leaves a gap;
    an image that cannot be decoded takes no number.  With ``figures``, labels are numbered in
    the same pass: ``figure`` counts saved images only, so it has no gaps.
    """
    decoded = image_refs.where(F.col("decoded"))
    counted = {"figure": F.col("saved")} if figures else None
    numbered = number_rows(decoded, [key], order, "image_number", large, group_rows, counted)
    return numbered.where(F.col("saved"))


def number_figures(
    numbered: DataFrame, large: LargeGroups | None = None, group_rows: int | None = None
) -> DataFrame:
    """Number the saved images 1..n for their labels, where this wasn't done along with the images."""
    return number_rows(numbered, ["doc_id"], ["image_number"], "figure", large, group_rows)


def slide_images(
    shapes: DataFrame, large: LargeGroups | None = None, group_rows: int | None = None
) -> DataFrame:
    """Pictures of a deck in list order (not by position): ``doc_id, page_no, image_number``."""
    pictures = shapes.where((F.col("kind") == "PICTURE") & F.col("decoded"))
    numbered = number_rows(
        pictures, ["doc_id"], ["page_no", "shape_no"], "image_number", large, group_rows
    )
    return numbered.where(F.col("saved")).select("doc_id", "page_no", "shape_no", "image_number")


def with_image_names(numbered: DataFrame, prefix: Column) -> DataFrame:
    return numbered.withColumn("image_name", n.image_name(prefix, F.col("image_number")))
