"""Convert files as they arrive, micro-batch by micro-batch.

A document depends on its own rows only, so a batch of new files is a small
corpus: the same plan runs on it inside ``foreachBatch``.  There is no state
between batches and no event time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.skew import BROADCAST_BYTES, NARROW
from ..plans.convert import DocumentTables, Options, convert
from ..session import scratch
from ..sources.corpus import path_ids, suffix_glob

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, root: str, any_case: bool = False) -> DataFrame:
    """Stream of ``doc_id, path`` for supported files below a folder, each once.

    The id comes from the path (``path_ids``); decoders that use other ids bring their own stream.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("pathGlobFilter", suffix_glob(any_case))
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return path_ids(files)


def convert_arrivals(
    files: DataFrame,
    decoded: Callable[[DataFrame], DocumentTables],
    folder: str,
    checkpoint: str,
    options: Options = Options(),
    once: bool = True,
) -> StreamingQuery:
    """Start converting a stream of ``doc_id, path``; ``once``: stop when all is converted.

    ``decoded`` gets the batch's files and gives their decoded tables, so that it can read
    just the partitions they are in; rows of other files are ignored.  Results go to ``<folder>/documents/batch=<n>`` and ``<folder>/report/batch=<n>``; a batch
    that runs again replaces its own folders, so no document is written twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        tables = decoded(batch)
        ids = batch.select("doc_id").distinct()
        if ids.count() * NARROW <= BROADCAST_BYTES:
            ids = F.broadcast(ids)
        mine = tables.restricted(lambda table: table.join(ids, "doc_id", "left_semi"))
        with scratch(batch.sparkSession):
            documents, report = convert(replace(mine, files=batch), options)
            documents.write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")
            report.write.mode("overwrite").parquet(f"{folder}/report/batch={number}")

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
