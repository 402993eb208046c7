"""File types and output names from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wording as w


def file_name(path: Column) -> Column:
    """Last component of a path; URI schemes and parent folders are dropped."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def suffix(name: Column) -> Column:
    """Last dot and what follows, as written; empty for dot-files and names without one."""
    return F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]+\z", "$1")


def file_type(name: Column) -> Column:
    """``pdf``, ``pptx`` or ``image``, whatever the case of the suffix; null otherwise."""
    kind = F.lower(suffix(name))
    return (
        F.when(kind.isin(w.PDF_SUFFIXES), "pdf")
        .when(kind.isin(w.SLIDE_SUFFIXES), "pptx")
        .when(kind.isin(w.IMAGE_SUFFIXES), "image")
    )


def sanitize_name(name: Column) -> Column:
    """Replace characters that file systems refuse, then trim dots and spaces."""
    return F.btrim(F.regexp_replace(name, w.NAME_FORBIDDEN, "_"), F.lit(w.NAME_TRIM))


def output_path(name: Column, folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), sanitize_name(stem(name)), F.lit(".md"))


def image_name(prefix: Column, number: Column) -> Column:
    """``prefix_image_001.png``; numbers grow past three digits, no prefix gives no underscore."""
    lead = F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("_")))
    return F.format_string("%simage_%03d.png", lead, number)


def image_link(label: Column, name: Column) -> Column:
    from .text import fill

    return fill(w.IMAGE_LINK, label=label, name=name)


def quoted(text: Column) -> Column:
    """Quote a value for an error message: single quotes unless only those occur in it.

    Tab and line ends are shown by their usual escapes.
    """
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        body = F.replace(body, F.lit(sign), F.lit(shown))
    single, double = F.contains(body, F.lit("'")), F.contains(body, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )
