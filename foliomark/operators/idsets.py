"""Sets of ids in front of a shuffle.

A list of ids that is too long to broadcast still fits into a bitmap of hashed ids.  Rows whose bit isn't set are
surely not in the set, so they needn't be shuffled to find out; the others are decided by an exact join.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import run_folder

# Bits that one bitmap row holds, as Spark's bitmap functions lay them out.
ROW_BITS = 32_768
# Bits for each id, and bits at most: 16 MB, whatever the corpus.
BITS_PER_ID, MOST_BITS = 8, 1 << 27
# Bytes that an id with its row counts for when a list's size is judged.
ID_BYTES = 16


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The written file gives Spark its true size, by which it decides on a broadcast.
    """
    folder = run_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_limit(spark) -> int:
    """Bytes up to which Spark broadcasts by itself; negative if it never does."""
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if setting.startswith("-"):
        return -1
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(setting)


def broadcastable(ids: DataFrame, number: int | None = None) -> bool:
    """Whether a written list of ids is small enough for Spark's own broadcasts."""
    limit = broadcast_limit(ids.sparkSession)
    return limit >= 0 and (ids.count() if number is None else number) * ID_BYTES <= limit


@dataclass(frozen=True)
class IdBitmap:
    """A bitmap of hashed ids, ``bits`` long.

    Of the rows of other ids, a share of ``wrong_share`` passes as well: one in nine at eight bits an id, more
    where MOST_BITS bound the bitmap (with 100 million ids, about half).
    """

    key: str
    rows: DataFrame
    bits: int
    ids: int

    @property
    def wrong_share(self) -> float:
        return 1 - exp(-self.ids / self.bits)

    @staticmethod
    def of(ids: DataFrame, key: str, number: int | None = None, bits_per_id: int = BITS_PER_ID, most_bits: int = MOST_BITS) -> IdBitmap:
        """From a written list of ids.  Each task sets bits of its own; the pieces are or-ed, map-side first."""
        number = ids.count() if number is None else number
        bits = ROW_BITS
        while bits < min(number * bits_per_id, most_bits):
            bits *= 2
        place = _place(key, bits)
        pieces = ids.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")
        )
        byte = F.transform(
            F.sequence(F.lit(1), F.lit(ROW_BITS // 8)),
            lambda at: F.conv(F.hex(F.substr(F.col("_bits"), at, F.lit(1))), 16, 10).cast("smallint"),
        )
        return IdBitmap(key, written(pieces.select("_bucket", byte.alias("_bytes")), "id-bitmap"), bits, number)

    def marked(self, df: DataFrame, name: str = "_maybe") -> DataFrame:
        """``df`` with a flag: whether the row's id may be in the set.  The bitmap, at most 16 MB packed, is broadcast."""
        place = _place(self.key, self.bits)
        position = F.bitmap_bit_position(place)
        byte = F.element_at("_bytes", (F.floor(position / 8) + 1).cast("int"))
        met = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(self.rows), "_bucket", "left")
        flag = F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))
        return met.select(*df.columns, flag.alias(name))

    def only(self, df: DataFrame) -> DataFrame:
        """Rows whose id may be in the set."""
        return self.marked(df).where("_maybe").drop("_maybe")

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows whose id is surely not in the set, and the others."""
        marked = self.marked(df)
        return marked.where("NOT _maybe").drop("_maybe"), marked.where("_maybe").drop("_maybe")


def _place(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1
