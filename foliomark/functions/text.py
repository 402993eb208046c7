"""Text normalisation as JVM-side column expressions.

White space means Unicode white space (flag ``U``) plus U+001C-1F throughout.
Lines end at ``\\n`` only, hence flag ``d`` wherever ``^`` is used: without it Java
would also react to ``\\r`` and other terminators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wording as w

_WS = r"[\s\x1c-\x1f]"
_BLANK = r"[\s\x1c-\x1f&&[^\n]]"
# Start of a line.  A run of blank lines is only entered at its first line (or right
# behind the previous match), so it is not walked again from each of its lines.  A line
# behind one that ends in a visible character needs no look at up to 40 others before.
_LINE_START = rf"^(?:\G|(?<!{_WS}\n)|(?<!\n{_BLANK}{{0,40}}\n))"


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` places of a fixed text with columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if before:
            parts.append(F.lit(before))
        parts.append(values[name].cast("string"))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def strip(text: Column) -> Column:
    """Remove white space at both ends (``trim`` alone would only drop spaces)."""
    return F.btrim(text, F.lit(w.WHITESPACE))


def is_blank(text: Column) -> Column:
    """True if ``strip`` would leave nothing; stops at the first visible character."""
    return ~F.rlike(text, F.lit(r"(?U)[^\s\x1c-\x1f]"))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def remove_control(text: Column) -> Column:
    """Delete control characters except tab, line feed and carriage return."""
    return F.regexp_replace(text, w.CONTROL_CHARS, "")


def normalize_headers(text: Column) -> Column:
    """Collapse repeated hash runs at a line start into the first run.

    A single run of two or more hashes also counts as repeated, because its last
    hash can serve as the second run: ``## X`` becomes ``# X``.  White space after
    the hashes, line breaks included, becomes one space.
    """
    return F.regexp_replace(text, rf"(?Umd)^(#{{1,6}}){_WS}*#+{_WS}*", "$1 ")


def normalize_lists(text: Column) -> Column:
    """Turn typographic bullets, then stars, at a line start into ``- ``.

    Blank lines in front of the bullet are swallowed with it.
    """
    for signs in (w.BULLETS, w.STAR):
        text = _bullets_to_dashes(text, signs)
    return text


def _bullets_to_dashes(text: Column, signs: str) -> Column:
    return F.regexp_replace(text, rf"(?Umd){_LINE_START}{_WS}*+[{signs}]{_WS}+", "- ")


def collapse_spaces(text: Column) -> Column:
    """Squeeze runs of spaces to one, except on lines that start with a bar.

    One pass: a table line is matched whole and put back as it is.  Only a bar or a space begins a match.
    """
    return F.regexp_replace(text, r"(?md)(?=[| ])(^\|[^\n]*+| (?= )) *+", "$1")


def limit_blank_lines(text: Column) -> Column:
    """At most one blank line in a row."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


# A pass changes nothing in a text that has none of these; remove_control has its own quick class.
_NEEDED = (
    (normalize_headers, ("#",)),
    (lambda text: _bullets_to_dashes(text, w.BULLETS), tuple(w.BULLETS)),
    (lambda text: _bullets_to_dashes(text, w.STAR), (w.STAR,)),
    (collapse_spaces, ("  ",)),
    (limit_blank_lines, ("\n\n\n",)),
)


def clean_unstripped(text: Column) -> Column:
    """The five cleaning passes in their fixed order, ends untouched.

    Each pass runs only on texts that hold something it could change: looking for a few bytes is much cheaper than
    a pattern.  The text is bound as the one element of an array, so that it is worked out once for both.
    """
    texts = F.array(remove_control(text))
    for step, signs in _NEEDED:
        texts = F.transform(texts, _where_needed(step, signs))
    return F.element_at(texts, 1)


def _where_needed(step, signs: tuple[str, ...]):
    def cleaned(text: Column) -> Column:
        found = reduce(Column.__or__, [F.contains(text, F.lit(sign)) for sign in signs])
        return F.when(found, step(text)).otherwise(text)

    return cleaned


def clean_markdown(text: Column) -> Column:
    """Clean a whole body.  Not idempotent: headings lose a hash on each run."""
    return strip(clean_unstripped(text))


def parse_languages(text: Column) -> Column:
    """``"es, en"`` to an array of stripped, non-empty entries."""
    entries = F.transform(F.split(text, ",", -1), strip)
    return F.filter(entries, lambda entry: entry != "")


def languages_or_default(languages: Column) -> Column:
    default = F.array(*[F.lit(code) for code in w.DEFAULT_LANGUAGES])
    return F.when(F.size(languages) > 0, languages).otherwise(default)


def ocr_language_codes(languages: Column) -> Column:
    """Two-letter codes to three-letter ones joined by ``+``; unknown ones pass as is."""
    pairs = [F.lit(item) for pair in w.LANGUAGE_CODES.items() for item in pair]
    known = F.create_map(*pairs)
    codes = F.transform(
        languages, lambda code: F.coalesce(F.try_element_at(known, F.lower(code)), code)
    )
    return F.array_join(codes, "+")


def front_matter(
    source: Column,
    pages: Column,
    generated_at: Column,
    engine: Column,
    quick_used: Column,
    languages: Column,
) -> Column:
    """Metadata header; values are written as they are, without quoting."""
    listed = F.array_join(languages_or_default(languages), ", ")
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("source: "), source),
        F.concat(F.lit("pages: "), pages.cast("string")),
        F.concat(F.lit("generated_at: "), F.date_format(generated_at, "yyyy-MM-dd")),
        F.concat(F.lit("ocr_engine: "), engine),
        F.concat(F.lit("markitdown_used: "), quick_used.cast("string")),
        F.concat(F.lit("languages: ["), listed, F.lit("]")),
        F.lit("---"),
    )


def markdown_document(header: Column, body: Column) -> Column:
    return F.concat(header, F.lit("\n\n"), body, F.lit("\n"))
