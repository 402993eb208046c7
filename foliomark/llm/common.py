"""What the operators of this subpackage share: columns, words, copies, running totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, run_folder

#: A word is a run of anything but space and the control characters tab to return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a bucket in `running_total`, and the most buckets that the keys are cut into.
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536
#: Numbers in one generated array of `expand_copies`.
SEQUENCE = 10_000


def named(name: str) -> Column:
    """A top-level column whatever its name contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have, for columns that are added and dropped again."""
    taken = {c.lower() for c in df.columns}
    tag = "" if not {w.lower() for w in wanted} & taken else f"_{uuid.uuid4().hex[:8]}"
    return [w + tag for w in wanted]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null.  Each word is shrunk to a letter, so no array of words is made."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(letters, BLANKS, "")).cast("long")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    folder = run_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def expand_copies(df: DataFrame, copies: str, index: str) -> DataFrame:
    """Each row ``copies`` times, numbered from 0 in ``index``, without an array of that length."""
    step = F.lit(SEQUENCE)
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / step))
    first = F.col(index) * step
    return (
        df.where(F.col(copies) > 0)
        .withColumn(index, F.explode(starts))
        .withColumn(index, F.explode(F.sequence(first, F.least(first + step, F.col(copies)) - 1)))
    )


def bucket_of(number: Column, buckets: int) -> Column:
    """The bucket, rising with ``number``, of a number drawn evenly from 0 to 2^32 - 1."""
    return F.shiftright(number.cast("long") * F.lit(buckets), 32)


def bucket_number(rows: int) -> int:
    """Buckets that `running_total` should get for so many rows."""
    return min(MOST_BUCKETS, max(1, -(-rows // BUCKET_ROWS)))


def running_total(rows: DataFrame, group: str, bucket: str, order: list[Column], value: str, before: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of ``group`` that come earlier.

    ``bucket`` has to rise with the order, so that a group is spread over many tasks: each bucket is
    summed by itself, and only one row per group and bucket is put in order.  ``rows`` is read twice and
    has to be stored.
    """
    totals = rows.groupBy(group, bucket).agg(F.sum(value).alias("bucket_total"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, bucket, F.coalesce(F.sum("bucket_total").over(earlier), F.lit(0)).alias("bucket_offset"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(offsets, [group, bucket])
        .withColumn(before, F.col("bucket_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("bucket_offset")
    )


def append_columns(df: DataFrame, source: list[str], added: T.StructType, make: Callable[..., Iterator[list]], at_once: int | None = None) -> DataFrame:
    """``df`` with the columns ``added`` that ``make`` computes, batch by batch in Arrow.

    ``make`` gets the Python lists of the columns ``source`` and returns one list for each added column; with
    ``at_once``, of so many rows at most.
    """
    schema = T.StructType(df.schema.fields + added.fields)
    places = [df.columns.index(c) for c in source]
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
        "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    types = [kinds[f.dataType.simpleString()] for f in added.fields]

    def run(batches):
        for batch in (b.slice(at, at_once) if at_once else b for b in batches for at in range(0, max(1, len(b)), at_once or max(1, len(b)))):
            made = make(*(batch.column(i).to_pylist() for i in places))
            columns = [*batch.columns, *(pa.array(v, t) for v, t in zip(made, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    # columns are matched by name, so both sides get plain distinct ones
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])
    inner = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return inner.mapInArrow(run, plain).toDF(*(f.name for f in schema.fields))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = [n for n in dir() if not n.startswith("_")] + ["checkpointed"]
