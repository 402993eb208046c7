"""Where documents go.

The table sink is the one for large corpora: few, large, splittable files, and no
document can overwrite another.  The file sinks make one file per document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as n
from ..operators.idsets import written
from ..session import shared_folder, without_shuffles_left
from .files_sink import STAGED, Staged, TextFilesWriter
from .paths import qualified


def write_table(documents: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Parquet, keyed by ``doc_id`` and ``part_no``."""
    documents.write.mode(mode).parquet(folder)


def write_text_folders(documents: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One folder per document and part with one UTF-8 text file in it.

    The text source ends a file with a line break of its own.
    """
    texts = documents.select(
        n.file_name(F.col("output")).alias("output_name"),
        "part_no",
        F.regexp_replace("markdown", r"\n\z", "").alias("value"),
    )
    texts.write.mode(mode).partitionBy("output_name", "part_no").text(folder)


def part_file(output: Column, part_no: Column) -> Column:
    """File of a part: the output itself, later parts as ``name.part<part_no>.md``."""
    later = F.concat(n.stem(output), F.lit(".part"), part_no, n.suffix(output))
    return F.when(part_no == 0, output).otherwise(later)


def _shared(spark: SparkSession, folder: str) -> str:
    """``folder`` qualified; refused if it is a machine's own and the tasks run on several."""
    folder = qualified(spark, folder)
    local = re.match(r"local(\[|$)", spark.sparkContext.master)
    known = qualified(spark, shared_folder(spark))
    if folder.startswith("file:") and not local and not f"{folder}/".startswith(f"{known.rstrip('/')}/"):
        raise ValueError(f"{folder} may be another folder on each machine; choose one below {known} or on a shared file system")
    return folder


def write_files(texts: DataFrame, folder: str) -> DataFrame:
    """Write ``file, text`` rows as UTF-8 files under a shared folder; ``file, bytes`` back.

    ``folder`` is resolved as Spark does it; its file system must be one that Arrow knows (hdfs, s3, gs, file).
    All files appear when the job commits, or none (`files_sink`).  Two rows with one name are refused before
    anything is written, as one would overwrite the other; a null text is an empty file.  The rows are stored
    first, so that they are worked out once for that check, the files and the result; shuffles that made them go
    before there are files.
    """
    spark = texts.sparkSession
    folder = _shared(spark, folder)
    with without_shuffles_left(spark):
        texts = written(texts.select("file", "text"), "texts")
    twice = texts.groupBy("file").count().where("count > 1").select("file").first()
    if twice:
        raise ValueError(f"several documents would be written to {twice[0]!r}")
    writer = TextFilesWriter(folder)
    try:
        # a written row is one of an attempt that counts
        tasks = written(texts.mapInArrow(lambda batches: writer.staged(batches), STAGED), "staged").collect()
        writer.commit([Staged(task["folder"], task["more"]) for task in tasks])
    except BaseException:
        writer.abort([])
        raise
    return texts.select("file", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))


def write_markdown_files(documents: DataFrame, folder: str) -> DataFrame:
    """One ``.md`` file per document (per part, for documents in parts)."""
    name = n.file_name(F.col("output"))
    return write_files(
        documents.select(
            part_file(name, F.col("part_no")).alias("file"), F.col("markdown").alias("text")
        ),
        folder,
    )
