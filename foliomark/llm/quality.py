"""Quality rules: fixed rules on a document's statistics, then gradient-boosted trees.

The trees are trained on a bounded, hashed sample of labelled documents, with scores that may only fall with
the share of symbols, repetition or capitals, and every document is scored by numpy in the one pass that also
counts its statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, named
from .trees import Trees, boosted

#: Labelled documents that the trees are trained on, about (drawn by a hash of the id).
SAMPLE = 20_000
#: Documents are kept from this probability of being good on: clean ones must not be lost to doubt.
KEEP_FROM = 0.3
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees, and how the score may change with each.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "duplicate_lines": -1, "repeated_words": -1,
    "capitals": -1, "exclamations": -1, "digits": 0, "stops": 0, "distinct_words": 0, "bars": -1, "line_words": 0,
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a run of ``window`` words that occurs twice or more."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):
        # made dense first, so that the product can't overflow
        key = np.unique(key, return_inverse=True)[1] if k > 1 else key
        key = key * len(seen) + ids[k : len(ids) - window + 1 + k]
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    inside = np.zeros(len(words), dtype=bool)
    for k in range(window):
        inside[k : len(words) - window + 1 + k] |= count[place] > 1
    return int(inside.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The numbers of COUNTS and FEATURES; a null text has no words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    bytes_ = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    blanks = bytes_[9:14].sum() + bytes_[32]
    points = len(data) - bytes_[0x80:0xC0].sum() - blanks
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols, duplicates = int(bytes_[list(SYMBOLS)].sum()), len(lines) - len(set(lines))
    n, repeated = len(words), repeated_words(words)
    some, letters = max(n, 1), max(int(points), 1)
    features = [
        np.log1p(n), points / some, symbols / some, duplicates / max(len(lines), 1), repeated / some,
        bytes_[65:91].sum() / letters, bytes_[33] / some, bytes_[48:58].sum() / letters, bytes_[46] / some,
        len(set(words)) / some, bytes_[124] / some, n / max(len(lines), 1),
    ]
    return [n, int(points), symbols, duplicates, repeated], list(map(float, features))


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Rows of COUNTS that the fixed rules reject."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED_PERCENT * counts[:, 0])


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int, doc_id: str, text: str) -> DataFrame:
    """label and features of about ``sample`` labelled documents.

    Several labels of an id are averaged, and of several documents with one id a single row is kept.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    whole = 1_000_000
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(whole)) < int(whole * share))
    # as many narrow rows as the sample has, so they can be broadcast
    rows = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    kind = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])

    def make(texts):
        return list(map(list, zip(*(statistics(t)[1] for t in texts), strict=True))) or [[] for _ in FEATURES]

    described = append_columns(rows, ["text"], kind, make)
    return described.groupBy("doc_id").agg(F.min(F.struct("good", *FEATURES)).alias("one")).select("one.*")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Trees | None:
    """Trees trained on labelled documents (labels: doc_id, quality 0 or 1); None without both kinds."""
    rows = labelled_features(docs, labels, sample, doc_id, text).toPandas()
    if rows["good"].nunique() < 2:
        return None
    rows = rows.sort_values(list(rows.columns))  # so that reruns agree
    return boosted(rows[list(FEATURES)].to_numpy(), rows["good"].to_numpy(dtype=float), list(FEATURES.values()))


def score(docs: DataFrame, model: Trees | None, names: list[str], text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the counts, base_failed, and kept, under the given names."""
    odds = np.log(keep_from / (1 - keep_from))

    def make(texts):
        if not texts:
            return [[] for _ in names]
        both = [statistics(t) for t in texts]
        counts, features = np.array([c for c, _ in both]), np.array([f for _, f in both])
        failed = base_failed(counts)
        kept = ~failed if model is None else ~failed & (model.sums(features) >= odds)
        return [*counts.T.tolist(), failed.tolist(), kept.tolist()]

    kinds = [T.LongType()] * len(COUNTS) + [T.BooleanType()] * 2
    return append_columns(docs, [text], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]), make)


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every row.

    A null text has no words and fails.  A document is kept if the fixed rules don't fail it and the trees
    give it ``keep_from`` or more; without labels of both kinds the fixed rules decide alone.  Repeated rows
    and null ids come out as they come in, labels without id or value are ignored, and so are other columns.
    An empty table gives no rows.
    """
    narrow = docs.select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    return score(narrow, train(docs, labels, sample, doc_id, text), [*COUNTS, "base_failed", "kept"], "text", keep_from).drop("text")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that `quality_rules` keeps, with all their columns."""
    names = fresh(docs, *COUNTS, "base_failed", "kept")
    scored = score(docs, train(docs, labels, sample, doc_id, text), names, text, keep_from)
    return scored.where(F.col(names[-1])).drop(*names)
