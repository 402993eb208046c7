"""Small helpers, and a character-by-character reading of the written cleaning rules."""

from pyspark.sql import functions as F


def apply(spark, step, values):
    """A column function over a list of texts."""
    rows = [(i, value) for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, text string").select("i", step(F.col("text")).alias("x"))
    return [row["x"] for row in df.orderBy("i").collect()]


CONTROLS = {chr(c) for c in (*range(32), 127)} - {"\t", "\n", "\r"}
BULLETS, STAR = "•·▪▸→", "*"


def end_of(text, at, inside):
    """Where the run of characters that are ``inside`` ends."""
    while at < len(text) and inside(text[at]):
        at += 1
    return at


def hashes(text, at):
    return end_of(text, at, lambda c: c == "#")


def blanks(text, at):
    return end_of(text, at, str.isspace)


def header_mark(text, at):
    """A doubled header mark at a line start: what is put there, and where the rest begins.

    Six hashes are kept at most; a second run of hashes, or the last hash of the only
    run, is dropped with the white space after it.
    """
    run = hashes(text, at)
    kept = min(run - at, 6)
    second = blanks(text, run) if kept == run - at else run - 1
    if kept < run - at:
        dropped = run
    elif text[second : second + 1] == "#":
        dropped = hashes(text, second)
    else:
        kept, dropped = kept - 1, run
    return ("#" * kept + " ", blanks(text, dropped)) if kept > 0 else None


def list_mark(signs):
    def mark(text, at):
        """White space, a sign and white space at a line start become a dash."""
        sign = blanks(text, at)
        after = blanks(text, sign + 1)
        return ("- ", after) if text[sign : sign + 1] in tuple(signs) and after > sign + 1 else None

    return mark


def at_line_starts(text, mark):
    out, at = [], 0
    while at < len(text):
        found = mark(text, at) if at == 0 or text[at - 1] == "\n" else None
        shown, at = found or (text[at], at + 1)
        out.append(shown)
    return "".join(out)


def halved(text, run, short):
    while run in text:
        text = text.replace(run, short)
    return text


def plain_clean(text):
    text = "".join(c for c in text if c not in CONTROLS)
    for mark in (header_mark, list_mark(BULLETS), list_mark(STAR)):
        text = at_line_starts(text, mark)
    lines = [line if line.startswith("|") else halved(line, "  ", " ") for line in text.split("\n")]
    return halved("\n".join(lines), "\n\n\n", "\n\n").strip()


def plain_document(blocks):
    return plain_clean("\n\n".join(block for block in blocks if block.strip()))
