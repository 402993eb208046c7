"""Golden rows and random texts for the text functions."""

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomark.functions import text as t

from .helpers import apply, plain_clean

GOLDEN = {
    "remove_control": [("a\x00\x01b\x7f\tc\r\n\x0bd", "ab\tc\r\nd")],
    "normalize_headers": [
        ("## X", "# X"),
        ("### X", "## X"),
        ("# X", "# X"),
        ("## ## Header", "## Header"),
        ("##\n\nt", "# t"),
        ("a # # b", "a # # b"),
        ("x\r## y", "x\r## y"),
        ("####### seven", "###### seven"),
        ("# # T", "# T"),
        ("#", "#"),
    ],
    "normalize_lists": [
        ("• one\n• two", "- one\n- two"),
        ("p\n\n• a", "p\n- a"),
        ("* * *", "- * *"),
        ("• * x", "- * x"),
        ("•\n\n• x", "- - x"),
        ("•\n  • x", "- • x"),
        ("•x", "•x"),
        ("a  \n  \n\t▪ b", "a  \n- b"),
        ("→ a\n\n\n* b", "- a\n- b"),
        ("\x1c• a", "- a"),
        ("a • b", "a • b"),
    ],
    "collapse_spaces": [
        ("a  b   c", "a b c"),
        ("| a   b |\nx  y", "| a   b |\nx y"),
        ("  - x", " - x"),
        (" |  a", " | a"),
        ("||  a\n|", "||  a\n|"),
        ("a\t\t b", "a\t\t b"),
        ("   ", " "),
    ],
    "limit_blank_lines": [("a\n\n\n\n\nb", "a\n\nb"), ("a\n\nb", "a\n\nb"), ("a\n \n\nb", "a\n \n\nb")],
    "strip": [("　\x1f a b \n", "a b"), ("​a", "​a"), ("", "")],
    "is_blank": [(" \n\x1c ", True), ("​", False), ("", True), ("a", False)],
    "clean_markdown": [
        ("\x01 \n## ## T\n\n\n\n• a\n| x   y |\nb  c \n", "## T\n- a\n| x   y |\nb c"),
        ("\n## Página 1\n", "# Página 1"),
        ("\x00", ""),
    ],
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    given_texts, wanted = zip(*GOLDEN[name])
    assert apply(spark, getattr(t, name), given_texts) == list(wanted)


def test_null_stays_null(spark):
    assert apply(spark, t.clean_markdown, [None]) == [None]


PIECES = st.lists(
    st.sampled_from(
        ["\n", "\n\n", " ", "  ", "\t", "#", "##", "•", "*", "→", "|", "-", "a", "ñb", "\x01", "\x1c"]
        + [" ", " ", "\r", "\x85", "• x", "* y", "# z", "| a  b |"]
    ),
    max_size=30,
).map("".join)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, min_size=60, max_size=120))
def test_cleaning_matches_plain_rules(spark, texts):
    assert apply(spark, t.clean_markdown, texts) == [plain_clean(text) for text in texts]


def test_cleaning_invariants(spark):
    texts = ["a\n\n\n\n\x02b  c", "\n\n\n", "• a\n\n\n\n\n* b\n\n\nc"]
    for text in apply(spark, t.clean_markdown, texts):
        assert "\n\n\n" not in text and "\x02" not in text and text == text.strip()


def test_cleaning_passes_run_where_needed_only(spark):
    """Every pass but the first stands behind a look for what it changes; leaving it out changes no text."""
    df = spark.createDataFrame([("plain",)], "text string").select(t.clean_markdown(F.col("text")).alias("text"))
    plan = df._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("case when") == plan.count("regexp_replace") - 1 == 5
    texts = [None, "", "plain\ntext", "one\n\n\ntwo", "a  b", "| a  b |", "x\n\n• y", "x\n  * y", "## ## z", "\x01#\x02# z\n\n\n\n→ q"]
    steps = (t.remove_control, t.normalize_headers, t.normalize_lists, t.collapse_spaces, t.limit_blank_lines)
    wanted = texts
    for step in steps:
        wanted = apply(spark, step, wanted)
    assert apply(spark, t.clean_unstripped, texts) == wanted


def test_long_blank_runs_take_linear_time(spark):
    """100,000 blank lines: walking the run again from each line would take minutes."""
    text = "a" + "\n" * 100_000 + "b" + "\n  " * 30_000 + "• c"
    assert apply(spark, t.clean_markdown, [text]) == ["a\n\nb\n- c"]


def test_parse_languages(spark):
    found = apply(spark, t.parse_languages, ["es, en", "es, EN,,JPN ", " , ", "", " fr\t"])
    assert found == [["es", "en"], ["es", "EN", "JPN"], [], [], ["fr"]]


def test_ocr_language_codes(spark):
    codes = apply(
        spark, lambda c: t.ocr_language_codes(t.parse_languages(c)), ["es,en", "es, EN,,JPN ", "spa,jpn"]
    )
    assert codes == ["spa+eng", "spa+eng+JPN", "spa+jpn"]


def test_front_matter(spark):
    def header(languages):
        return t.front_matter(
            F.lit("documento.pdf"), F.lit(5), F.lit(date(2024, 3, 1)), F.lit("paddle"), F.lit(False),
            t.parse_languages(languages),
        )

    texts = apply(spark, header, ["fr,de", ""])
    assert texts[0].split("\n") == [
        "---",
        "source: documento.pdf",
        "pages: 5",
        "generated_at: 2024-03-01",
        "ocr_engine: paddle",
        "markitdown_used: false",
        "languages: [fr, de]",
        "---",
    ]
    assert "languages: [es, en]" in texts[1]
