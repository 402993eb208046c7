"""From a folder of files to documents and a report, as one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch
from ..sources.corpus import distinct_sorted_paths, path_ids, scan_corpus
from ..sources.sinks import write_table
from .convert import DocumentTables, Options, convert


def convert_folder(
    spark: SparkSession,
    root: str,
    decoded: Callable[[DataFrame], DocumentTables],
    target: str,
    options: Options = Options(),
    recursive: bool = False,
    any_case: bool = False,
) -> None:
    """Convert the supported files of a folder into ``<target>/documents`` and ``<target>/report``.

    ``decoded`` gets the files (``doc_id, path``, each once) and gives their decoded tables.
    """
    listed = scan_corpus(spark, root, recursive, any_case)
    files = path_ids(distinct_sorted_paths(listed))
    with scratch(spark):
        documents, report = convert(replace(decoded(files), files=files), options)
        write_table(documents, f"{target}/documents")
        report.write.parquet(f"{target}/report")
