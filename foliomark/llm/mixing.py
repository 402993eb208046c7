"""Mixing sources to target weights: hash-random order, distributed running totals, exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_number, bucket_of, checkpointed, expand_copies, fresh, named, running_total, stored, word_count

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: The table of sources (a name and five numbers each) is broadcast up to so many rows, counted.
BROADCAST_SOURCES = 100_000


def in_order(rows: DataFrame, order: Sequence[Column], *values: str) -> DataFrame:
    """``rows`` with place (from 0) and, for each of ``values``, its sum over the rows before, as before_<value>.

    Rows are sorted by range and numbered inside their partitions; only one row per partition is put in order in
    one task.  Range bounds are sampled, so the sorted rows are checkpointed.
    """
    ranged = checkpointed(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    )
    sums = {"place": F.count(F.lit(1)), **{f"before_{v}": F.sum(v) for v in values}}
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(*(total.alias(name) for name, total in sums.items()))
    offsets = parts.select("part", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_offset") for name in sums))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    own = {"place": F.count(F.lit(1)).over(inside), **{f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}}
    placed = ranged.join(F.broadcast(offsets), "part").withColumns({name: total + F.col(f"{name}_offset") for name, total in own.items()})
    return placed.select(*rows.columns, *sums)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with source_rank and target.

    Sources get the weights in code-point order, null last, repeating.  The targets share the sum of all
    sizes by weight; a source gets ``epochs`` times its size at most, and what is left over is shared by
    the others.  Sources may be as many as documents: they are ranked and summed range by range.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = in_order(sizes, [F.col("source").asc_nulls_last()]).withColumnRenamed("place", "source_rank").withColumn("weight", weight)
    every_size, every_weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # sources reach their cap in the order of size per weight; the first that doesn't, sets the level
    by_cap = [(F.col("source_size") / F.col("weight")).asc(), F.col("source_rank").asc()]
    level = (F.lit(every_size) - epochs * F.col("before_source_size")) / (F.lit(every_weight) - F.col("before_weight"))
    leveled = in_order(ranked, by_cap, "source_size", "weight").withColumn("level", level)
    below = leveled.where(F.col("level") * F.col("weight") <= epochs * F.col("source_size"))
    found = below.agg(F.min(F.struct("place", "level"))["level"]).first()[0]
    cap = epochs * F.col("source_size").cast("double")
    share = cap if found is None else F.least(F.lit(found) * F.col("weight"), cap)
    return ranked.select("source", "source_rank", "source_size", share.alias("target"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """How many words of each document the mix takes: one row per distinct (source, doc_id, size), with
    copies, source_size, target, passes, rest and before.

    A source's rounded target is used up by whole passes over it and then by the documents in the order of
    the MD5 of their id: with ``before`` words ahead of it, the i-th copy takes
    ``passes * size + min(size, max(0, rest - before - i * size))`` words.
    """
    rows = docs.select(named(doc_id).alias("doc_id"), named(source).alias("source"), word_count(named(text)).alias("size"))
    rows = checkpointed(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")))
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, epochs))
    budget = F.floor(F.col("target") + 0.5)
    targets = targets.select(
        F.col("source").alias("its_source"), "source_rank", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("passes"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("rest"),
    )
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    keyed = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("its_source")))
        .withColumn("key", key)
        .withColumn("bucket", bucket_of(F.conv(F.substring("key", 1, 8), 16, 10), bucket_number(rows.count())))
        .withColumn("words", F.col("size") * F.col("copies"))
    )
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    return running_total(keyed, "source_rank", "bucket", order, "words", "before").drop("its_source", "bucket", "words", "key")


def mixed_words(plan: DataFrame) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken."""
    taken = F.col("passes") * F.col("size") + F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("copy") * F.col("size"))
    )
    return expand_copies(plan, "copies", "copy").select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes) of every row.

    Words are counted; a null or blank text has none, and nothing is taken of it.  A null source is a source
    of its own, the last one; a null id is an id like any other.  Repeated rows take their turns one by one
    (which of them is which doesn't matter).  Documents with the same key are put in the order of their id
    and size.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return mixed_words(mix_plan(docs, doc_id, text, source, weights, epochs))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with all its columns.

    Documents stay whole: the one that a source's budget ends in comes in full once more.  Documents
    without words cost nothing and come once for each begun pass over their source.  Of rows that agree in
    source, id and size, only so many come once more as the budget reaches; which of them doesn't matter.
    A null text has no words; a null source is a source, null ids are ids like others; an empty table gives no rows.
    """
    taken, size, copy = (F.col(c) for c in ("rest", "size", "copies"))
    partly = F.when(size > 0, F.greatest(F.lit(0), F.least(copy, F.ceil((taken - F.col("before")) / size)))).otherwise(
        F.when(taken > 0, copy).otherwise(0)
    )
    key, plan_key, t, i, row, group, extra, chosen = fresh(
        docs, "mix_key_", "mix_plan_key_", "mix_times_", "mix_copy_", "mix_row_", "mix_group_", "mix_extra_", "mix_chosen_"
    )
    plan = checkpointed(
        mix_plan(docs, doc_id, text, source, weights, epochs).select(
            F.struct("source", "doc_id", "size").alias(plan_key),
            (F.col("passes") + F.when(partly == copy, 1).otherwise(0)).cast("long").alias(t),
            F.when(partly < copy, partly).otherwise(0).cast("long").alias(extra),
            F.monotonically_increasing_id().alias(group),
        )
    )
    # the rows that a budget ends in, at most one group a source, are numbered
    tied = not plan.where(F.col(extra) > 0).isEmpty()
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixed-documents") if tied else docs
    keyed = rows.withColumn(key, F.struct(named(source).alias("source"), named(doc_id).alias("doc_id"), word_count(named(text)).alias("size")))
    joined = keyed.join(plan, F.col(key).eqNullSafe(F.col(plan_key))).drop(plan_key, key)
    if tied:
        number = F.xxhash64(row).bitwiseAND(0xFFFFFFFF)
        ends = checkpointed(joined.where(F.col(extra) > 0).select(row, group, extra, number.alias("number"), F.lit(1).alias("one")))
        bucketed = ends.withColumn("bucket", bucket_of(F.col("number"), bucket_number(ends.count())))
        numbered = running_total(bucketed, group, "bucket", [F.col("number"), F.col(row)], "one", "ahead")
        once_more = numbered.where(F.col("ahead") < F.col(extra)).select(F.col(row).alias(chosen))
        joined = joined.join(once_more, F.col(row) == F.col(chosen), "left").withColumn(t, F.col(t) + F.col(chosen).isNotNull().cast("long")).drop(row, chosen)
    return expand_copies(joined.drop(extra, group), t, i).drop(t, i)
