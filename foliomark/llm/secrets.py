"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are found in whole texts.  The forest is trained on labelled findings (a bounded, hashed sample) from
a candidate's length, character transitions and dictionary coverage, its path, and the words around it, and is
flattened into numpy arrays that score all candidates of a batch at once.  The dictionary is made of the words that
most of the corpus' documents share.  What is stored between jobs are numbers and digests, never a secret.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, fresh, named
from .trees import Trees, forest

#: Labelled findings that the forest is trained on, about (drawn by a hash of the finding).
SAMPLE = 20_000
#: Share of the trees that have to call a candidate a secret.
SECRET_FROM = 0.5
#: Characters before and after a candidate that are looked at.
BEFORE, AFTER = 48, 24
REDACTED = "[REDACTED]"

_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth(?:orization)?"
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")
_ASSIGNED = re.compile(rf"(?i:{_NAMES})s?[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?(?i:(?:Bearer|Basic)[ \t]{{1,3}})?([^\s\"'<>]{{6,}})")
_RUN = re.compile(r"[A-Za-z0-9+/=_\-]{16,}")
#: A private key: its first line, header lines, lines of base64, and maybe its end.  Lines may be told apart by any
#: white space or a written-out line break.  Without a long line of base64 it is a mention, not a key; without an end
#: it goes as far as its lines do.
_GAP, _KEY = r"(?:\s|\\[nr])*", r"PRIVATE KEY(?: BLOCK)?-----"
_BLOCK = re.compile(
    rf"-----BEGIN [A-Z0-9 ]{{0,40}}{_KEY}{_GAP}(?:[A-Za-z][A-Za-z-]{{0,40}}: [^\n\\]{{0,200}}(?:\n|\\n){_GAP})*"
    rf"(?:[A-Za-z0-9+/=]{{32,}}{_GAP})+(?:[A-Za-z0-9+/=]{{1,31}}{_GAP}(?=-----END)|[A-Za-z0-9+/]{{1,29}}={{1,2}}(?![A-Za-z0-9+/=]))?"
    rf"(?:-----END [A-Z0-9 ]{{0,40}}{_KEY})?"
)
_VENDOR = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]+")
_DIGIT = re.compile(r"\d")
_WORD_BEFORE = re.compile(rf"(?i)(?:{_NAMES})s?[\"']?\s*[:=]?\s*[\"']?(?:(?:Bearer|Basic)\s+)?$")
_PATH = re.compile(r"(?i)test|example|sample|fixture|doc|readme|mock")
#: Words and numbers with signs between them.
_WORDY = r"^(?:[A-Za-z]{3,}[0-9]{0,4}|[0-9]+)(?:[+/=_-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]+))*[+/=_-]*$"
#: What stands before and after a secret that has no name: a blank, or an address.
UNNAMED = ((" ", " "), ("", "\n"), (" https://api/v1?", " "), (" https://files/", "/"))
_MADE_UP = re.compile(r"(?i)example|placeholder|changeme|your[_-]|xxxx|dummy|<|\$\{")
#: Words of the dictionary at most, the fewest documents that hold one, and the shortest and longest word in it.
DICTIONARY, LEAST_DOCUMENTS, SHORTEST, LONGEST = 20_000, 3, 3, 14
#: Words that a task counts before it passes them on.
COUNTED = 50_000
#: Ranks of words for each doubling of their number of documents.
RANKS = 64
_WORD = re.compile(rf"(?<![a-z])[a-z]{{{SHORTEST},{LONGEST}}}(?![a-z])")

FEATURES = [
    "length", "transitions", "coverage", "entropy", "distinct", "digits", "uppers", "lowers", "others", "hexadecimal",
    "vendor", "named", "assigned", "quoted", "address", "made_up", "plain_path",
]
#: The same as columns.
NUMBERS = [f"x_{name}" for name in FEATURES]
#: Those that a candidate's kind and surroundings decide, whatever its value and path.
AROUND = ["vendor", "named", "assigned", "quoted", "address"]
#: Texts whose candidates are in a task's memory together.
AT_ONCE = 1_000
FINDING = "start int, length int, kind string, path string, before string, value string, after string"


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a whole text in order, without overlaps."""
    if not text:
        return []
    found = [(m.start(), m.end(), "token") for m in _RUN.finditer(text) if _DIGIT.search(m.group())]
    if "-----BEGIN" in text:
        found += [(m.start(), m.start() + len(m[0].rstrip()), "private_key") for m in _BLOCK.finditer(text)]
    if any(x in text for x in ("AKIA", "ASIA", "gh", "xox", "sk_live_", "eyJ")):
        found += [(m.start(), m.end(), "vendor") for m in _VENDOR.finditer(text)]
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(1), m.end(1), "assigned") for m in _ASSIGNED.finditer(text)]
    order = {"private_key": 0, "vendor": 1, "assigned": 2, "token": 3}
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda x: (order[x[2]], x[0])):
        i = bisect_left(kept, (a,))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or b <= kept[i][0]):
            kept.insert(i, (a, b, kind))
    return kept


def frequent_words(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> frozenset[str]:
    """The dictionary: words (runs of letters, A-Z lower-cased) that most documents hold, ``size`` at most.

    Counted over all documents; words of fewer than LEAST_DOCUMENTS are left out, so that no single secret's
    letters are a word.  Words are ranked by the logarithm of their number of documents; a rank comes whole or not
    at all, so the driver gets no more than ``size`` words.
    """

    def run(batches):
        import pyarrow as pa

        def row(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts = Counter()
        for batch in batches:
            for t in batch.column("text"):
                if t := t.as_py():
                    counts.update(set(_WORD.findall(t.lower())))
                if len(counts) >= COUNTED:
                    yield row(counts)
                    counts.clear()
        yield row(counts)

    counted = docs.select(named(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = checkpointed(counted.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("rank", F.floor(F.log2("n") * RANKS).cast("int")))
    # from the top, as many ranks as there is room for
    lowest, room = None, size
    for r in sorted(often.groupBy("rank").count().collect(), key=lambda r: -r["rank"]):
        room -= r["count"]
        if room < 0:
            break
        lowest = r["rank"]
    return frozenset() if lowest is None else frozenset(r["word"] for r in often.where(F.col("rank") >= lowest).select("word").collect())


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters inside words of the dictionary, longest word first from the left."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low):
        n = next((n for n in range(LONGEST, SHORTEST - 1, -1) if low[i : i + n] in words and i + n <= len(low)), 0)
        covered += n
        i += n or 1
    return covered / max(len(low), 1)


def describe(kind: str, path: str | None, before: str, value: str, after: str, words: frozenset[str] = frozenset()) -> list[float]:
    """The numbers of FEATURES for one candidate."""
    n = max(len(value), 1)
    classes = np.fromiter((0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value), dtype=np.int8, count=len(value))
    shares = (np.bincount(classes, minlength=4) / n).tolist()
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [
        math.log(n), float((classes[1:] != classes[:-1]).sum()) / max(n - 1, 1), _coverage(value, words), entropy,
        len(counts) / n, shares[2], shares[1], shares[0], shares[3],
        float(all(c in "0123456789abcdefABCDEF" for c in value) and shares[2] < 1),
        float(kind in ("vendor", "private_key")), float(bool(_WORD_BEFORE.search(before))), float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before != "" and after[:1] in "\"'" and after != ""),
        float("@" in before[-1:] + after[:1] or "://" in before.rsplit(" ", 1)[-1]), float(bool(_MADE_UP.search(value))),
        float(bool(_PATH.search(path or ""))),
    ]


def _scores(model: Trees | None, x: np.ndarray, kinds: list[str]) -> np.ndarray:
    # without a forest every candidate that a pattern names stays
    return model.sums(x) if model and len(x) else np.array([float(k != "token") for k in kinds])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", words=None) -> DataFrame:
    """One row per candidate: doc_id, start, length, kind, path, before, value, after.

    With ``words``, the sent dictionary, also the numbers of FEATURES: made by the same Python worker, since a second
    one for each task would hold memory of its own.
    """
    numbers = NUMBERS if words else []
    kind = T.ArrayType(T.StructType(T.StructType.fromDDL(FINDING).fields + [T.StructField(name, T.DoubleType()) for name in numbers]))
    narrow = docs.select(named(doc_id).alias("doc_id"), named(path).cast("string").alias("path"), named(text).alias("text"))

    def row(where, t, a, b, k):
        made = {"start": a, "length": b - a, "kind": k, "path": where, "before": t[max(0, a - BEFORE) : a], "value": t[a:b], "after": t[b : b + AFTER]}
        if words:
            made.update(zip(numbers, describe(k, where, made["before"], made["value"], made["after"], words.value), strict=True))
        return made

    def run(batches):
        import pyarrow as pa

        strings, doubles = ("kind", "path", "before", "value", "after"), numbers
        fields = [("start", pa.int32()), ("length", pa.int32()), *((n, pa.string()) for n in strings), *((n, pa.float64()) for n in doubles)]
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, len(b), AT_ONCE)):
            texts = zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)
            rows = [[row(where, t, *c) for c in candidates(t)] for where, t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.struct(fields)))], names=["doc_id", "found"])

    schema = T.StructType([narrow.schema["doc_id"], T.StructField("found", kind)])
    return narrow.mapInArrow(run, schema).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def _ruled(findings: DataFrame) -> DataFrame:
    """Findings with the rules' label (null where none is sure) and bare: whether it is a copy without its name."""
    value = F.col("value")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16)
    made_up = value.rlike(_MADE_UP.pattern)
    mail = F.col("after").startswith("@") & ~F.col("before").rlike("://[^ ]*$")
    label = (
        F.when(made_up, 0)
        .when(F.col("kind").isin("vendor", "private_key"), 1)
        .when(value.rlike(r"^[0-9+/=_\-]+$") | value.rlike("^[A-Za-z_/=+-]+$"), 0)
        .when((F.col("kind") == "assigned") & mixed, 1)
        .when((F.col("kind") == "token") & (mail | (F.length(value) <= 256) & value.rlike(_WORDY)), 0)
    )
    # numbers that the findings have already are those of the copy's own surroundings
    changed = {f"x_{name}": FEATURES.index(name) for name in AROUND if f"x_{name}" in findings.columns}

    def surroundings(before, after):
        of = describe("token", None, before, "x", after)
        return F.struct(F.lit(before).alias("before"), F.lit(after).alias("after"), *(F.lit(of[i]).alias(x) for x, i in changed.items()))

    around = F.element_at(
        F.array(*(surroundings(*u) for u in UNNAMED)),
        (F.pmod(F.xxhash64("value"), F.lit(len(UNNAMED))) + 1).cast("int"),
    )
    copied = (F.col("label") == 1) & (F.col("kind") == "assigned") & value.rlike(rf"^{_RUN.pattern}$")

    def form(kind, at, bare):
        return F.struct(kind.alias("kind"), *(at(c).alias(c) for c in ("before", "after", *changed)), F.lit(bare).alias("bare"))

    own = form(F.col("kind"), F.col, False)
    forms = F.when(copied, F.array(own, form(F.lit("token"), around.getField, True))).otherwise(F.array(own))
    labelled = findings.withColumn("label", label).withColumn("form", F.explode(forms))
    formed = {"kind", "before", "after", *changed}
    return labelled.select(*(F.col(f"form.{c}").alias(c) if c in formed else named(c) for c in findings.columns), "label", "form.bare")


def rule_labels(findings: DataFrame) -> DataFrame:
    """Findings with a label where fixed rules are sure: 1 for vendors' formats, wherever they stand, and for
    random values that are assigned to a secret's name; 0 for numbers, made-up values, words, and names in
    mail addresses.

    No rule is sure of a random value without a name.  So that the forest knows such secrets, each random value
    that has one comes once more as a token, with one of UNNAMED around it.
    """
    return _ruled(findings).where("label IS NOT NULL").drop("bare")


def _described(findings: DataFrame, words) -> DataFrame:
    """Findings with the numbers of FEATURES and the value's digest in place of value, path and surroundings."""
    columns = ["kind", "path", "before", "value", "after"]
    added = T.StructType([T.StructField(name, T.DoubleType()) for name in NUMBERS])

    def make(*given):
        return np.array([describe(*r, words.value) for r in zip(*given, strict=True)]).reshape(-1, len(FEATURES)).T

    return _digested(append_columns(findings, columns, added, make))


def _digested(findings: DataFrame) -> DataFrame:
    """Findings with the value's digest in place of value, path and surroundings."""
    return findings.withColumn("value_sha256", F.sha2("value", 256)).drop("path", "before", "value", "after")


def _trained(labelled: DataFrame, sample: int) -> Trees | None:
    """A forest from described findings with a label; None without both labels.

    Of each label, half of ``sample`` are drawn by a hash at most, about; the same finding counts once.
    """
    labelled = labelled.where("label IS NOT NULL").dropDuplicates(["doc_id", "start", "value_sha256", "kind"])
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    whole = 1_000_000
    share = F.when(F.col("label") == 1, int(whole * min(1, sample / 2 / sizes[1]))).otherwise(int(whole * min(1, sample / 2 / sizes[0])))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", "start", "value_sha256"), F.lit(whole)) < share)
    rows = drawn.select(*NUMBERS, "label").toPandas()
    if rows["label"].nunique() < 2:
        return None
    x = rows.to_numpy(dtype=float)
    x = x[np.lexsort(x.T[::-1])]  # so that reruns agree
    return forest(x[:, :-1], x[:, -1])


def _learned(docs: DataFrame, labelled: DataFrame | None, doc_id: str, text: str, path: str, sample: int):
    """The described candidates of ``docs`` (stored, without copies), the forest, and the sent dictionary."""
    words = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text))
    found = find(docs, doc_id, text, path, words)
    if labelled is None:
        rows = checkpointed(_digested(_ruled(found)))
        return rows.where("NOT bare"), _trained(rows, sample), words
    return checkpointed(_digested(found)), _trained(checkpointed(_described(labelled, words)), sample), words


def scan(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source", sample: int = SAMPLE, secret_from: float = SECRET_FROM) -> DataFrame:
    """doc_id, start, length, kind, value_sha256, score and is_secret of every candidate.

    ``labelled`` are findings with labels; without any, those that fixed rules are sure of.  With labels of
    one kind only, the patterns' own kinds decide.  Starts and lengths count code points.  The value itself is
    neither returned nor stored in between.  A long value without a name, a vendor's form or a
    digit is no candidate.  A null or empty text has no candidates; a null path is an empty one; null ids and
    repeated rows are passed through; other columns are ignored; an empty table gives no rows.
    """
    found, model, _ = _learned(docs, labelled, doc_id, text, path, sample)
    kind = T.StructType([T.StructField("score", T.DoubleType())])
    make = lambda kinds, *x: [_scores(model, np.array(x).T, kinds).tolist()]
    scored = append_columns(found.select("doc_id", "start", "length", "kind", "value_sha256", *NUMBERS), ["kind", *NUMBERS], kind, make)
    return scored.select("doc_id", "start", "length", "kind", "value_sha256", "score", (F.col("score") >= secret_from).alias("is_secret"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", path: str = "source", sample: int = SAMPLE, secret_from: float = SECRET_FROM) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a mark; nothing else changes.

    What is a secret is as in `scan`.  Null and empty texts stay as they are; null ids, null paths, repeated rows and
    other columns are kept; an empty table gives no rows.
    """
    _, model, words = _learned(docs, labelled, doc_id, text, path, sample)

    def make(texts, paths):
        places, rows = [], []
        for i, t in enumerate(texts):
            for a, b, k in candidates(t):
                places.append((i, a, b))
                rows.append((k, None if paths[i] is None else str(paths[i]), t[max(0, a - BEFORE) : a], t[a:b], t[b : b + AFTER]))
        cuts: dict[int, list[tuple[int, int]]] = {}
        x = np.array([describe(*r, words.value) for r in rows]).reshape(-1, len(FEATURES))
        for (i, a, b), s in zip(places, _scores(model, x, [r[0] for r in rows]), strict=True):
            if s >= secret_from:
                cuts.setdefault(i, []).append((a, b))
        out = list(texts)
        for i, spans in cuts.items():
            pieces, at = [], 0
            for a, b in spans:
                pieces += [out[i][at:a], REDACTED]
                at = b
            out[i] = "".join(pieces) + out[i][at:]
        return [out]

    (clean,) = fresh(docs, "clean_text_")
    cleaned = append_columns(docs, [text, path], T.StructType([T.StructField(clean, T.StringType())]), make, AT_ONCE)
    return cleaned.select(*(named(clean).alias(c) if c == text else named(c) for c in docs.columns))
