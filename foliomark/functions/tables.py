"""Markdown tables from arrays of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def table_line(cells: Column) -> Column:
    """A missing cell is an empty one."""
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def rule_line(width: Column) -> Column:
    return table_line(F.array_repeat(F.lit("---"), width))


def fit(cells: Column, width: Column) -> Column:
    """Pad a row with empty cells, or cut it, to ``width``."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def _render(rows: Column, width: Column) -> Column:
    head = table_line(fit(F.element_at(rows, 1), width))
    body = F.transform(
        F.slice(rows, F.lit(2), F.size(rows)), lambda cells: table_line(fit(cells, width))
    )
    return F.array_join(F.concat(F.array(head, rule_line(width)), body), "\n")


def table_width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def table_md_padded(rows: Column) -> Column:
    """Page table: as wide as its widest row, cells as they are; null if there is nothing."""
    width = table_width(rows)
    return F.when(width > 0, _render(rows, width))


def slide_cell(cell: Column) -> Column:
    return F.replace(strip(cell), F.lit("\n"), F.lit(" "))


def table_md_header_width(rows: Column) -> Column:
    """Slide table: as wide as its header; cells stripped and put on one line."""
    tidy = F.transform(rows, lambda cells: F.transform(cells, slide_cell))
    return F.when(F.size(rows) > 0, _render(tidy, F.size(F.element_at(rows, 1))))
