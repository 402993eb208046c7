"""Groups too large for one task.

Numbering and text building work per document or page.  Almost every group is
small, and then one shuffle on the key is the best plan.  A *large* group (more
rows than a limit or, where its text is built, more characters) is taken out and
cut into ordered slices by Spark's range partitioning on (key, order); slices are
worked on in parallel and tied together by running totals over one row per slice.

Finding large groups begins with a sketch: rows and characters are added up in a
fixed number of cells that keys are hashed to, twice.  A group can't be large if a cell
of its key isn't, so only groups in two full cells are counted exactly, and usually there
are none: no list of keys is shuffled, and no text ever.  The keys found are stored once
and counted, and they are broadcast only up to ``BROADCAST_BYTES``; beyond that the
split is a shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..session import checkpointed

# Rows of one group that a single task may hold.
GROUP_ROWS = 200_000
# Cells that keys are hashed to, and how often; a full cell is 16 bytes, so all of them are 2 MB.
CELLS, HASHED = 65_536, 2
# Bytes that may be broadcast, and bytes of a row: keys (digests of 64 letters) and numbers, or also names of a file.
BROADCAST_BYTES, NARROW, WIDE = 16 << 20, 96, 1_024


@dataclass(frozen=True)
class LargeGroups:
    """Keys of the large groups, or none of them (``keys_df`` is then unused)."""

    keys: tuple[str, ...]
    keys_df: DataFrame
    number: int
    # rows of all large groups together
    rows: int = 0

    def __bool__(self) -> bool:
        return self.number > 0

    def bounded(self, df: DataFrame, row_bytes: int = NARROW) -> DataFrame:
        """Broadcast a frame that has a row or so per large group, if so many rows of that size are few bytes."""
        return F.broadcast(df) if self.number * row_bytes <= BROADCAST_BYTES else df

    def without(self, df: DataFrame) -> DataFrame:
        if not self:
            return df
        return df.join(self.bounded(self.keys_df), list(self.keys), "left_anti")

    def only(self, df: DataFrame) -> DataFrame:
        return df.join(self.bounded(self.keys_df), list(self.keys), "left_semi")


def suspects(
    df: DataFrame, keys: Sequence[str], full: Callable[[Column, Column], Column], chars: Column, cells: int | None = None
) -> DataFrame | None:
    """Rows (keys and ``_chars``) whose key's cells are all full; None if there is no full cell.

    A count-min sketch: a cell has the rows and characters of all its keys, so it is never too low.
    ``full`` decides from both sums.
    """
    places = [F.pmod(F.xxhash64(F.lit(turn), *keys), F.lit(cells or CELLS)).cast("int") for turn in range(HASHED)]
    rows = df.select(*keys, F.coalesce(chars, F.lit(0)).cast("bigint").alias("_chars"))
    each = F.explode(F.array(*(F.struct(F.lit(turn).alias("_turn"), place.alias("_cell")) for turn, place in enumerate(places))))
    sums = rows.select("_chars", each.alias("_at")).groupBy("_at._turn", "_at._cell").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_chars").alias("_sum")
    )
    over = checkpointed(sums.where(full(F.col("_rows"), F.col("_sum"))).select("_turn", "_cell"))
    if over.isEmpty():
        return None
    for turn, place in enumerate(places):
        mine = over.where(F.col("_turn") == turn).select("_cell")
        rows = rows.withColumn("_cell", place).join(F.broadcast(mine), "_cell", "left_semi").drop("_cell")
    return rows


def find_large_groups(
    df: DataFrame,
    keys: Sequence[str],
    group_rows: int | None = None,
    chars: Column | None = None,
    group_chars: int | None = None,
) -> LargeGroups:
    """Keys over a limit of rows or characters: a sketch of all keys, then an exact count of what it suspects."""
    limit = GROUP_ROWS if group_rows is None else group_rows
    measured = chars is not None and group_chars is not None

    def full(rows: Column, sum_: Column) -> Column:
        return (rows > limit) | (sum_ > group_chars) if measured else rows > limit

    found = suspects(df, keys, full, F.lit(0) if chars is None else chars)
    if found is None:
        return LargeGroups(tuple(keys), df.select(*keys).limit(0), 0)
    sizes = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_chars").alias("_sum"))
    large = checkpointed(sizes.where(full(F.col("_rows"), F.col("_sum"))).select(*keys, "_rows"))
    number, rows = large.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    return LargeGroups(tuple(keys), large.select(*keys), number, rows or 0)


def slice_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], large: LargeGroups | None = None
) -> DataFrame:
    """Add ``_slice``: contiguous, balanced runs of each group in its order.

    There are enough slices for none to hold more than ``GROUP_ROWS`` rows or so.
    Range bounds come from a sample, so the result is checkpointed: every later
    read has to see the same slices.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(usual, -(-(large.rows if large else 0) // GROUP_ROWS))
    ranged = df.repartitionByRange(slices, *[F.col(name) for name in (*keys, *order)])
    return checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))


def in_slice(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_slice").orderBy(*order)


def before_slice(keys: Sequence[str]) -> WindowSpec:
    """All earlier slices of the same group; one row per slice."""
    return (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
    counted: dict[str, Column] | None = None,
) -> DataFrame:
    """1-based row number in each group.  ``order`` must be unique in a group.

    ``counted`` adds running counts of conditions, this row included, in the same order: one
    sort and one window give them all.
    """
    large = find_large_groups(df, keys, group_rows) if large is None else large
    ones = {at: F.when(condition, 1).otherwise(0).cast("bigint") for at, condition in (counted or {}).items()}

    def numbered(rows: DataFrame, window: WindowSpec, before: dict[str, Column]) -> DataFrame:
        up_to_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = {name: F.row_number().over(window).cast("bigint")}
        found |= {at: F.sum(one).over(up_to_here) for at, one in ones.items()}
        return rows.withColumns({at: n + before[at] if before else n for at, n in found.items()})

    usual = numbered(large.without(df), Window.partitionBy(*keys).orderBy(*order), {})
    if not large:
        return usual
    sliced = slice_groups(large.only(df), keys, order, large)
    names = [name, *ones]
    per_slice = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias(f"_{name}"), *(F.sum(one).alias(f"_{at}") for at, one in ones.items())
    )
    offsets = per_slice.select(
        *keys,
        "_slice",
        *(F.coalesce(F.sum(f"_{at}").over(before_slice(keys)), F.lit(0)).alias(f"_{at}") for at in names),
    )
    joined = sliced.join(large.bounded(offsets), [*keys, "_slice"])
    cut = numbered(joined, in_slice(keys, order), {at: F.col(f"_{at}") for at in names})
    return usual.unionByName(cut.select(*df.columns, *names))


def join_per_group(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    how: str,
    large: LargeGroups | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Join rows to a table with at most one row per group.

    Rows of large groups stay where they are: they meet a broadcast of just
    their own group rows instead of being shuffled to one task.
    """
    large = find_large_groups(rows, keys, group_rows) if large is None else large
    usual = large.without(rows).join(groups, list(keys), how)
    if not large:
        return usual
    their_groups = large.bounded(large.only(groups), WIDE)
    return usual.unionByName(large.only(rows).join(their_groups, list(keys), how))


def ordered_join(order: Sequence[str], text: Column, separator: str) -> Column:
    """Aggregate: the group's texts in order, joined."""
    entries = F.sort_array(F.collect_list(F.struct(*order, text.alias("_text"))))
    return F.array_join(F.transform(entries, lambda entry: entry["_text"]), separator)
