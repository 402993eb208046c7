"""Join texts in order, in one piece or in parts.

A group's text is one value up to ``PART_CHARS`` characters, however many rows it
is made of.  A longer one comes out as several rows: ``part_no`` counts from 0 along
the text, and the parts joined with nothing between them are the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions import wording as w
from .skew import (
    WIDE,
    LargeGroups,
    before_slice,
    find_large_groups,
    in_slice,
    ordered_join,
    slice_groups,
)

# Characters after which a part of a large group's text is closed.
PART_CHARS = 32_000_000

_MARKS = f"#{w.BULLETS}{w.STAR}"
_SOLID = rf"(?U)[^\s\x1c-\x1f{_MARKS}]"


class Texts(NamedTuple):
    """Texts of groups: those in one piece, those in parts, and which groups the latter are."""

    whole: DataFrame
    parts: DataFrame | None
    large: LargeGroups

    def union(self) -> DataFrame:
        return self.whole if self.parts is None else self.whole.unionByName(self.parts)

    def with_last_part(self, keys: Sequence[str]) -> Texts:
        """Mark the part that ends each text; one narrow row per large group is added."""
        if self.parts is None:
            return self._replace(whole=self.whole.withColumn("last_part", F.lit(True)))
        ends = self.parts.groupBy(*keys).agg(F.max("part_no").alias("_end"))
        marked = self.parts.join(self.large.bounded(ends), list(keys)).withColumn(
            "last_part", F.col("part_no") == F.col("_end")
        )
        whole = self.whole.withColumn("last_part", F.lit(True))
        return Texts(whole, marked.drop("_end"), self.large)

    def left_join(self, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Join one-row-per-group ``groups`` to their texts; groups without text stay.

        The parts of a large group stay spread out: its one row comes to them.
        """
        usual = self.large.without(groups).join(self.whole, list(keys), "left")
        if self.parts is None:
            return usual
        large_groups = self.large.only(groups)
        cut = self.parts.join(self.large.bounded(large_groups, WIDE), list(keys), "inner")
        begun = self.parts.where(F.col("part_no") == 0).select(*keys)
        bare = large_groups.join(begun, list(keys), "left_anti")
        return usual.unionByName(cut).unionByName(bare, allowMissingColumns=True)


def _large(
    df: DataFrame, keys: Sequence[str], group_rows: int | None, text: str, part_chars: int
) -> LargeGroups:
    return find_large_groups(df, keys, group_rows, F.length(text), part_chars)


def ordered_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    separator: str,
    name: str = "text",
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    part_chars: int = PART_CHARS,
) -> Texts:
    """``keys, part_no, <name>``: each group's texts in order with ``separator`` between.

    A null text is left out; a group of nothing else has an empty text.
    """
    large = _large(df, keys, group_rows, text, part_chars) if large is None else large
    whole = (
        large.without(df)
        .groupBy(*keys)
        .agg(ordered_join(order, F.col(text), separator).alias(name))
        .select(*keys, F.lit(0).cast("bigint").alias("part_no"), name)
    )
    if not large:
        return Texts(whole, None, large)
    texts = large.only(df).where(F.col(text).isNotNull())
    rows = _assign_parts(large, texts, keys, order, text, None, len(separator), part_chars, None)
    lead = F.when(F.col("part_no") == 0, "").otherwise(separator)
    parts = (
        rows.groupBy(*keys, "part_no")
        .agg(ordered_join(order, F.col(text), separator).alias("_joined"))
        .select(*keys, "part_no", F.concat(lead, F.col("_joined")).alias(name))
    )
    silent = large.keys_df.join(texts.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit(0).cast("bigint").alias("part_no"), F.lit("").alias(name)
    )
    return Texts(whole, parts.unionByName(silent), large)


def clean_body(
    blocks: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    name: str = "body",
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    part_chars: int = PART_CHARS,
) -> Texts:
    """``keys, part_no, last_part, <name>``: blocks joined by a blank line, then cleaned.

    If there is a boolean column ``same_block``, rows with true carry on the block
    before them (a table line, an image link) after a single line break; such rows
    must neither start nor end with white space.
    """
    large = _large(blocks, keys, group_rows, text, part_chars) if large is None else large
    whole = clean_whole(large.without(blocks), keys, order, text, name)
    if not large:
        return Texts(whole, None, large)
    parts = clean_parts(large, large.only(blocks), keys, order, text, name, part_chars)
    return Texts(whole, parts, large)


def clean_whole(
    blocks: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, name: str = "body"
) -> DataFrame:
    """One shuffle on the keys; one row per group."""
    joined = blocks.groupBy(*keys).agg(_joined_blocks(blocks, order, text).alias("_joined"))
    return joined.select(
        *keys,
        F.lit(0).cast("bigint").alias("part_no"),
        F.lit(True).alias("last_part"),
        t.clean_markdown(F.col("_joined")).alias(name),
    )


def clean_parts(
    large: LargeGroups,
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    name: str = "body",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """The same text for large groups, in parts.

    Cleaning looks across line ends, so a text may only be cut where no pattern
    can reach over the cut (``_cut_rule``).  Each part is cleaned by itself, and
    the parts joined give the text cleaned as a whole.

    """
    if "same_block" not in rows.columns:
        rows = rows.withColumn("same_block", F.lit(False))
    rows = _assign_parts(large, rows, keys, order, text, "same_block", 2, part_chars, _cut_rule)
    joined = rows.groupBy(*keys, "part_no", "_last_part").agg(
        _joined_blocks(rows, order, text).alias("_joined"),
        F.min_by("same_block", F.struct(*order)).alias("_same_block"),
    )
    first, last = F.col("part_no") == 0, F.col("part_no") == F.col("_last_part")
    cleaned = t.clean_unstripped(F.col("_joined"))
    blanks, breaks = F.lit(w.WHITESPACE), F.lit("\n")
    cleaned = F.when(last, F.rtrim(cleaned, blanks)).otherwise(F.rtrim(cleaned, breaks))
    cleaned = F.when(first, F.ltrim(cleaned, blanks)).otherwise(F.ltrim(cleaned, breaks))
    # a bullet swallows the blank line in front of it
    one_break = F.col("_same_block") | _starts_with_bullet(F.col("_joined"))
    lead = F.when(first, "").when(one_break, "\n").otherwise("\n\n")
    return joined.select(
        *keys, "part_no", last.alias("last_part"), F.concat(lead, cleaned).alias(name)
    )


def _joined_blocks(blocks: DataFrame, order: Sequence[str], text: str) -> Column:
    """Aggregate: the blocks in order, each with the line breaks that precede it.

    The breaks in front of the first block are harmless: cleaning drops them.
    """
    if "same_block" not in blocks.columns:
        return ordered_join(order, F.col(text), "\n\n")
    entries = F.sort_array(
        F.collect_list(F.struct(*order, F.col(text).alias("_text"), "same_block"))
    )
    led = F.transform(
        entries,
        lambda row: F.concat(F.when(row["same_block"], "\n").otherwise("\n\n"), row["_text"]),
    )
    return F.array_join(led, "")


def _starts_with_bullet(text: Column) -> Column:
    pattern = rf"(?U)\A[\s\x1c-\x1f]*[{w.BULLETS}{w.STAR}][\s\x1c-\x1f]"
    return F.rlike(t.remove_control(text), F.lit(pattern))


def _cut_rule(text: Column) -> tuple[Column, Column]:
    """(may a part start with this block, may a part end with this block).

    Header and bullet patterns consist of marks and white space only.  They
    cannot leave a block whose last line holds any other character, and nothing
    is left open if only line breaks follow that line.  A block that vanishes
    with its control characters starts nothing.
    """
    kept = t.remove_control(text)
    last_line = F.substring_index(F.rtrim(kept, F.lit("\n")), "\n", -1)
    return ~t.is_blank(kept), F.rlike(last_line, F.lit(_SOLID))


def _assign_parts(
    large: LargeGroups,
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    flag: str | None,
    separator_chars: int,
    part_chars: int,
    cut_rule,
) -> DataFrame:
    """Add ``part_no`` (counting from 0) and ``_last_part`` to large groups."""
    columns = [*keys, *order, text, *([flag] if flag else [])]
    rows = rows.select(*columns)
    starts, ends = cut_rule(F.col(text)) if cut_rule else (F.lit(True), F.lit(True))
    rows = slice_groups(
        rows.withColumn("_chars", F.length(text).cast("bigint") + separator_chars)
        .withColumn("_starts", starts)
        .withColumn("_ends", ends),
        keys,
        order,
        large,
    )
    local = in_slice(keys, order)
    up_to_here = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_here = local.rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_slice")
    earlier = before_slice(keys)

    per_slice = rows.groupBy(*keys, "_slice").agg(
        F.sum("_chars").alias("_sum"),
        F.max_by("_ends", F.struct(*order)).alias("_last_ends"),
    )
    offsets = per_slice.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_chars_before"),
        F.coalesce(F.lag("_last_ends").over(along), F.lit(False)).alias("_slice_open"),
    )
    rows = (
        rows.join(large.bounded(offsets), [*keys, "_slice"])
        .withColumn("_prev_ends", F.coalesce(F.lag("_ends").over(local), F.col("_slice_open")))
        .withColumn(
            "_chars_so_far",
            F.col("_chars_before") + F.coalesce(F.sum("_chars").over(before_here), F.lit(0)),
        )
        .withColumn(
            "_part_start",
            F.when(
                F.col("_starts") & F.col("_prev_ends"),
                F.floor(F.col("_chars_so_far") / F.lit(part_chars)).cast("bigint"),
            ),
        )
    )
    # a part runs from one allowed start to the next that lies in a later stretch
    starts_per_slice = rows.groupBy(*keys, "_slice").agg(F.max("_part_start").alias("_max_start"))
    carried = starts_per_slice.select(
        *keys,
        "_slice",
        F.coalesce(F.max("_max_start").over(earlier), F.lit(0)).alias("_carried"),
    )
    rows = rows.join(large.bounded(carried), [*keys, "_slice"]).withColumn(
        "_stretch",
        F.greatest(
            F.col("_carried"),
            F.coalesce(F.max("_part_start").over(up_to_here), F.lit(0)),
        ),
    )
    # a stretch without an allowed start is no part, so the parts are counted anew
    stretches = rows.select(*keys, "_stretch").distinct()
    numbered = stretches.select(
        *keys,
        "_stretch",
        (F.row_number().over(Window.partitionBy(*keys).orderBy("_stretch")) - 1)
        .cast("bigint")
        .alias("part_no"),
        (F.count(F.lit(1)).over(Window.partitionBy(*keys)) - 1).alias("_last_part"),
    )
    return rows.join(large.bounded(numbered), [*keys, "_stretch"]).select(
        *columns, "part_no", "_last_part"
    )
