"""Tables found on pages: choice of extractor and Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as tb
from .parts import PART_CHARS, ordered_text
from .skew import LargeGroups, find_large_groups, join_per_group

PAGE = ["doc_id", "page_no"]
TABLE = ["doc_id", "page_no", "table_no", "extractor"]
# The second extractor's row 0 holds its column names.
SECOND = 2


def as_printed(table_rows: DataFrame) -> DataFrame:
    """Missing cells as the extractors print them: ``nan`` by the second, empty by the first."""
    missing = F.when(F.col("extractor") == SECOND, "nan").otherwise("")
    return table_rows.withColumn(
        "cells", F.transform("cells", lambda cell: F.coalesce(cell, missing))
    )


def table_facts(table_rows: DataFrame) -> DataFrame:
    """One row per table, aggregated map-side: row count, widest row, header row number."""
    return table_rows.groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("cells")).alias("width"),
        F.min("row_no").alias("header_no"),
    )


def nonempty(facts: DataFrame) -> DataFrame:
    """Tables with a cell; from the second extractor, with a row besides the header."""
    least = F.when(F.col("extractor") == SECOND, 2).otherwise(1)
    return facts.where((F.col("width") > 0) & (F.col("n_rows") >= least))


def nonempty_tables(table_rows: DataFrame) -> DataFrame:
    return nonempty(table_facts(table_rows))


def first_successful(facts: DataFrame) -> DataFrame:
    """Per page, the tables of the first extractor that found a non-empty one."""
    best = facts.groupBy(*PAGE).agg(F.min("extractor").alias("extractor"))
    return facts.join(best, [*PAGE, "extractor"], "left_semi")


def table_extractor_fallback(table_rows: DataFrame) -> DataFrame:
    return first_successful(nonempty_tables(table_rows))


def page_tables_md(
    table_rows: DataFrame,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """``doc_id, page_no, table_no, extractor, part_no, md`` for the tables to print.

    One shuffle by page serves both the tables and the choice between extractors.
    Pages with very many rows go line by line (``table_lines``) instead.
    """
    if large is None:
        large = find_large_groups(table_rows, PAGE, group_rows, cell_chars(), part_chars)
    usual = tables_md(large.without(table_rows))
    if not large:
        return usual
    lines = table_lines(large.only(table_rows), group_rows)
    parts = ordered_text(
        lines, TABLE, ["row_no"], "md", "\n", "md", group_rows=group_rows, part_chars=part_chars
    )
    return usual.unionByName(parts.union())


def cell_chars() -> Column:
    """Characters in a row's cells."""
    return F.aggregate("cells", F.lit(0), lambda n, cell: n + F.length(F.coalesce(cell, F.lit(""))) + 3)


def tables_md(table_rows: DataFrame, by: Sequence[str] = PAGE) -> DataFrame:
    """Tables in one shuffle ``by`` page, or by document if the rows are or will be dealt so anyway."""
    by_page = as_printed(table_rows)
    by_page = by_page.repartition(*by) if list(by) == PAGE else by_page
    rows = F.transform(
        F.sort_array(F.collect_list(F.struct("row_no", "cells"))), lambda row: row["cells"]
    )
    least = F.when(F.col("extractor") == SECOND, 2).otherwise(1)
    tables = (
        by_page.groupBy(*TABLE)
        .agg(rows.alias("_rows"))
        .where((F.size("_rows") >= least) & (tb.table_width(F.col("_rows")) > 0))
        .withColumn("_best", F.min("extractor").over(Window.partitionBy(*PAGE)))
    )
    return tables.where(F.col("extractor") == F.col("_best")).select(
        *TABLE,
        F.lit(0).cast("bigint").alias("part_no"),
        tb.table_md_padded(F.col("_rows")).alias("md"),
    )


def table_lines(table_rows: DataFrame, group_rows: int | None = None) -> DataFrame:
    """The same tables as one row per line: table columns, ``row_no, header_no, md``.

    The width of a table comes from a map-side aggregation, so no task has to
    hold a whole table.  The header row carries the rule line.
    """
    facts = table_extractor_fallback(table_rows)
    rows = join_per_group(as_printed(table_rows), facts, TABLE, "inner", group_rows=group_rows)
    line = tb.table_line(tb.fit(F.col("cells"), F.col("width")))
    head = F.concat(line, F.lit("\n"), tb.rule_line(F.col("width")))
    return rows.select(
        *TABLE,
        "row_no",
        "header_no",
        F.when(F.col("row_no") == F.col("header_no"), head).otherwise(line).alias("md"),
    )
