"""A training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the
next stage.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.bpe import bpe_encode
from foliomark.llm.common import read_table, stored
from foliomark.llm.mixing import mixed_documents
from foliomark.llm.quality import keep_good
from foliomark.llm.secrets import redact
from foliomark.llm.simhash import simhash_dedup

TOKENIZER = "byte_bpe_50k.json"

#: The stages train models, link documents and tokenize, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trees learn from the labels beside the documents.

    A null or empty text has no words and goes.  Null ids are no one's labels; repeated rows are judged alike; other
    columns stay; an empty table gives no rows.
    """
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Null, empty and blank texts have one fingerprint and are one group.  A row without id stays only where its group
    has no id, and one of several rows with the smallest id stays.  Other columns stay; an empty table gives no rows.
    """
    return simhash_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars is counted anew unless it is null.

    Null and empty texts, null ids and sources, repeated rows and other columns stay as they are.
    """
    # n_chars is about the new texts
    return redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix of the sources takes it.

    A null source is a source of its own; a text without words costs nothing and comes for each begun pass.  Rows that
    agree in source, id and size are taken one by one; other columns stay; an empty table gives no rows.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every document, null ids and repeated rows included.

    A null or empty text has no ids; an empty table gives no rows.
    """
    import public_tokenizers

    encoded = bpe_encode(docs, public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixture),
    ("BPE encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
