"""Filter interaction audit: what each filter removes, alone and after others, in every order.

Each document becomes a mask of the filters that it fails; documents of one part with the same mask are one cell
with three weights.  A cell folds across all orders (one array in the plan) and gives a weighted struct for each
order and step; the structs of a part's cells are summed elementwise.  So the work on orders depends on the number
of cells, never on that of documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, named, stored

MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
#: Filters by letter; the bit of a filter in a mask is its place here.
FILTERS = "ABCDE"
WEIGHTS = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: fewer than 200 words; under half of the words distinct; over 3 % of the characters in A-Z;
    one of the symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    tests = [
        n < MIN_WORDS,
        F.lit(100).cast("long") * distinct < F.lit(DISTINCT_PERCENT).cast("long") * n,
        F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(UPPER_PERCENT).cast("long") * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, good and toxic of every row of ``docs``."""
    (rows_id,) = fresh(labels, "label_id")
    narrow = stored(
        docs.select(
            named(doc_id).alias("doc_id"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"),
            F.coalesce(named(text), F.lit("")).alias("text"),
        ).select("doc_id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")),
        "audit",
    )
    # copies are counted before the shuffle; only texts that occur more than once come back
    copied = narrow.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    flags = labels.select(named("doc_id").alias(rows_id), "quality", "toxic").groupBy(rows_id).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    no = F.lit(False)
    return (
        narrow.join(copied, "digest", "left")
        .select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))
        .join(flags, F.col("doc_id") == F.col(rows_id), "left")
        .select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    )


def _fold(orders: Column) -> Column:
    """The structs of a cell (mask and weights), order after order, step after step."""
    n, good, toxic, none = F.col("n"), F.col("good"), F.col("toxic"), F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = F.col("mask").bitwiseAND(bit) != 0
        here = state["alive"]
        made = F.struct(
            F.when(here & ~fails, n).otherwise(none).alias("kept"),
            F.when(here & fails, n).otherwise(none).alias("removed"),
            F.when(~here & fails, n).otherwise(none).alias("redundant"),
            F.when(F.col("mask") == bit, n).otherwise(none).alias("unique_fails"),
            F.when(here & fails, good).otherwise(none).alias("good_lost"),
            F.when(here & fails, toxic).otherwise(none).alias("toxic_lost"),
        )
        return F.struct((here & ~fails).alias("alive"), F.array_append(state["steps"], made).alias("steps"))

    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def audit_filters(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, the six counts and shapley from cells (part, mask, n, good, toxic).

    One row for each part, order of ``filters`` (its letters, the first is bit 0) and step from 1 on.  kept and
    removed are after and by the step's filter; redundant fail it but were removed before; unique_fails fail it
    alone; good_lost and toxic_lost are the weights of what it removes; shapley adds up what the filter removes in
    all orders.  Cells of the same part and mask may come in several rows.  No cells give no rows.
    """
    names = ["".join(p) for p in permutations(filters)]
    orders = F.lit([[1 << filters.index(c) for c in name] for name in names])
    folded = cells.groupBy("part", "mask").agg(*(F.sum(w).cast("long").alias(w) for w in WEIGHTS)).select("part", _fold(orders).alias("steps"))

    def plus(a: Column, b: Column) -> Column:
        return F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))

    # 2 ** len(filters) cells of a part at most meet here
    gathered = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    first, rest = F.element_at("cells", 1), F.slice("cells", 2, F.size("cells"))
    merged = gathered.select("part", F.aggregate(rest, first, lambda total, one: F.zip_with(total, one, plus)).alias("steps"))
    letters = F.lit([c for name in names for c in name])
    removed = F.transform("steps", lambda s: s["removed"])
    shapley = F.create_map(*(
        x for c in filters
        for x in (F.lit(c), F.aggregate(F.zip_with(removed, letters, lambda r, own: F.when(own == c, r).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b))
    ))
    width = len(filters)
    return (
        merged.withColumn("shares", shapley)
        .select("part", "shares", F.posexplode("steps").alias("at", "s"))
        .select(
            "part",
            F.element_at(F.lit(names), F.floor(F.col("at") / width).cast("int") + 1).alias("filter_order"),
            (F.col("at") % width + 1).cast("int").alias("step"),
            *(F.col(f"s.{c}").alias(c) for c in COUNTS),
            F.element_at("shares", F.element_at(letters, F.col("at") + 1)).alias("shapley"),
        )
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """`audit_filters` of the five filters over whole documents, by part.

    A null text counts as empty, a null part as the empty string.  E fails where any row with a smaller id has the
    same text (by SHA-256); a null id is neither smaller nor larger than others.  A document is good or toxic if any
    of its labels says so; without labels it is neither.  Repeated rows count as often as they come and are no copies
    of each other.  Other columns are ignored; an empty table gives no rows.
    """
    rows = masked(docs, labels, doc_id, text, part)
    weights = [F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    return audit_filters(rows.groupBy("part", "mask").agg(*weights))
