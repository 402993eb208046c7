"""Decoded tables stored by document, for corpora that are converted more than once.

The tables of usual documents are bucketed by ``doc_id``: a conversion of them shuffles nothing but its report,
since plan, joins, numbering and gathering all work inside a bucket.  Documents too large for one task are
stored beside them, without buckets, so that no bucket holds more than documents of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from dataclasses import replace as replaced

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parts import Texts
from ..operators.skew import LargeGroups, find_large_groups
from ..session import run_folder
from .convert import (
    Chosen,
    Conversion,
    DocumentTables,
    Options,
    formatted,
    large_bodies,
    pages_with_lines,
    plan_documents,
    usual_bodies,
)

#: Spark leaves buckets unused below a union, unless told otherwise.
BUCKETS_BELOW_UNIONS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
#: A bucket is one sorted file here, so joins needn't sort it again; Spark counts on that only if told to.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class StoredTables:
    """Bucketed tables of usual documents, plain tables of large ones, and the list of these."""

    usual: DocumentTables
    rest: DocumentTables
    large: LargeGroups
    buckets: int
    name: str


def _mapped(tables: DocumentTables, change: Callable[[str, DataFrame], DataFrame]) -> DocumentTables:
    given = {field.name: getattr(tables, field.name) for field in fields(tables)}
    return DocumentTables(**{at: None if df is None else change(at, df) for at, df in given.items()})


def _bucketed(df: DataFrame, folder: str, table: str, buckets: int) -> DataFrame:
    """``df`` written as one sorted file for each bucket, and as a table of the session's catalog."""
    dealt = df.repartition(buckets, "doc_id").sortWithinPartitions("doc_id")
    dealt.write.bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", folder).saveAsTable(table)
    return df.sparkSession.table(table)


def store_tables(
    tables: DocumentTables, folder: str, name: str, buckets: int, options: Options = Options()
) -> StoredTables:
    """Write decoded tables below ``folder`` and as tables ``<name>_<table>``.

    The lines that an engine read are put into their pages on the way, by the rule of ``options.ocr_engine``;
    ``options.group_rows`` and ``part_chars`` say which documents are large.  ``buckets`` should be about the
    cluster's shuffle partitions: a conversion has that many tasks.
    """
    keys = tables.row_sizes().union(
        tables.quick_text.select("doc_id", F.lit(1), F.coalesce(F.length("text"), F.lit(0)))
    ).union(tables.doc_pages.select("doc_id", F.lit(1), F.coalesce(F.length("ocr_text"), F.lit(0))))
    large = find_large_groups(keys, ["doc_id"], options.group_rows, F.col("_chars"), options.part_chars)
    ready = pages_with_lines(tables, options)
    spark = tables.files.sparkSession

    def plain(at: str, df: DataFrame) -> DataFrame:
        large.only(df).write.parquet(f"{folder}/large/{at}")
        return spark.read.schema(df.schema).parquet(f"{folder}/large/{at}")

    large.keys_df.write.parquet(f"{folder}/large-ids")
    usual = _mapped(ready, lambda at, df: _bucketed(large.without(df), f"{folder}/usual/{at}", f"{name}_{at}", buckets))
    rest = _mapped(ready, plain)
    ids = spark.read.schema(large.keys_df.schema).parquet(f"{folder}/large-ids")
    return StoredTables(usual, rest, replaced(large, keys_df=ids), buckets, name)


def open_tables(spark: SparkSession, folder: str, name: str, buckets: int) -> StoredTables:
    """What `store_tables` wrote, in a session whose catalog doesn't know the tables."""
    names = [field.name for field in fields(DocumentTables) if field.name != "ocr_lines"]
    usual, rest = {}, {}
    for at in names:
        place = f"{folder}/usual/{at}"
        columns = spark.read.parquet(place)._jdf.schema().toDDL()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name}_{at} ({columns}) USING parquet"
            f" CLUSTERED BY (doc_id) SORTED BY (doc_id) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        usual[at] = spark.table(f"{name}_{at}")
        rest[at] = spark.read.schema(usual[at].schema).parquet(f"{folder}/large/{at}")
    ids = spark.read.parquet(f"{folder}/large-ids")
    number = ids.count()
    rows = sum(df.count() for df in rest.values()) if number else 0
    return StoredTables(DocumentTables(**usual), DocumentTables(**rest), LargeGroups(("doc_id",), ids, number, rows), buckets, name)


def convert_stored(stored: StoredTables, options: Options = Options()) -> Conversion:
    """`convert` of stored tables: of usual documents no decoded row is shuffled.

    The plan is stored in the same buckets.  Sets BUCKETS_BELOW_UNIONS and SORTED_BUCKETS for the session, which the
    result needs when it is run; engine, quick tier, images and date may differ from run to run.
    """
    spark = stored.usual.files.sparkSession
    spark.conf.set(BUCKETS_BELOW_UNIONS, "false")
    spark.conf.set(SORTED_BUCKETS, "true")
    folder = run_folder(spark, "stored-plan")
    table = f"{stored.name}_plan_{folder.rpartition('-')[2]}"
    docs = _bucketed(plan_documents(stored.usual, options), folder, table, stored.buckets)
    none = replaced(stored.large, number=0)
    whole = usual_bodies(stored.usual, Chosen.of(docs, none, bitmap=False), options)
    if not stored.large:
        return formatted(docs, Texts(whole, None, none), options)
    theirs = run_folder(spark, "stored-plan")
    plan_documents(stored.rest, options).write.parquet(theirs)
    large_docs = spark.read.schema(docs.schema).parquet(theirs)
    parts = large_bodies(stored.rest, Chosen.of(large_docs, stored.large, bitmap=False), options)
    return formatted(docs.unionByName(large_docs), Texts(whole, parts, stored.large), options)
