"""Listing input files, folder by folder, and reading their bytes or texts.

Folders are listed by tasks, level by level, so the driver never holds the list of files; zero-length files and
names that start with ``_`` or ``.`` are listed like others.  Texts are read by tasks, too; bytes are read by Spark's
own binary file source, which keeps its list of files on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions import names as n
from ..functions import wording as w
from ..operators.idsets import written
from .paths import exists, opened, qualified

LISTED = "path string, length long, modificationTime timestamp, is_folder boolean"
# Folders that one task lists, about, and entries that it hands on at once.
FOLDERS_PER_TASK, LISTED_AT_ONCE = 64, 10_000
# Files and bytes that one task reads, about, and bytes of texts that it hands on at once.
FILES_PER_TASK, BYTES_PER_TASK, READ_AT_ONCE = 2_000, 32 << 20, 4 << 20


def suffix_glob(any_case: bool = False) -> str:
    """Glob over all supported suffixes; lower case only, unless ``any_case``."""
    bare = [s[1:] for s in (*w.PDF_SUFFIXES, *w.SLIDE_SUFFIXES, *w.IMAGE_SUFFIXES)]
    if any_case:
        bare = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in bare]
    return "*.{" + ",".join(bare) + "}"


def _described(files: DataFrame, *more: str) -> DataFrame:
    file = n.file_name(F.col("path"))
    return files.select(
        "path",
        file.alias("file"),
        n.file_type(file).alias("kind"),
        "length",
        "modificationTime",
        *more,
    )


def _binary_files(spark: SparkSession) -> DataFrameReader:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true")


def _found(target, folder: str) -> Iterator[tuple]:
    """``path, length, modification time in microseconds, is_folder`` of what is in a folder.

    A local folder gives its entries one by one, however many there are; other file systems answer as a whole.
    """
    from pyarrow import fs

    def described(info) -> tuple:
        changed = None if info.mtime_ns is None else info.mtime_ns // 1_000
        return info.path, info.size or 0, changed, info.type == fs.FileType.Directory

    if not isinstance(target, fs.LocalFileSystem):
        yield from map(described, target.get_file_info(fs.FileSelector(folder, recursive=False)))
        return
    with os.scandir(folder) as entries:
        while paths := [entry.path for entry in islice(entries, LISTED_AT_ONCE)]:
            yield from map(described, target.get_file_info(paths))


def _entries(folders: DataFrame, root: str) -> DataFrame:
    """What is in each of the folders (``path``), itself not included; one call of the file system for each."""

    def run(batches):
        import pyarrow as pa

        target, top = opened(root)
        scheme = root.removesuffix(top)
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = _found(target, path.removeprefix(scheme))
                try:
                    while rows := list(islice(found, LISTED_AT_ONCE)):
                        paths, *rest = zip(*rows, strict=True)
                        columns = [[scheme + at for at in paths], *rest]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "length", "modificationTime", "is_folder"]
                        )
                except FileNotFoundError:
                    continue  # gone since it was listed

    return folders.mapInArrow(run, LISTED)


def list_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of every file in a folder, or also below it.

    Level by level: the folders of a level are dealt out to tasks, and what they hold is written to the shared
    folder, so that neither files nor folders pass through the driver.  The file system has to be one that Arrow
    knows (hdfs, s3, gs, file); a missing folder is an error.
    """
    root = qualified(spark, root.rstrip("/") or "/")
    if not exists(spark, root):
        raise FileNotFoundError(f"[PATH_NOT_FOUND] {root}")
    folders, number, files = spark.createDataFrame([(root,)], "path string"), 1, None
    while number:
        level = written(_entries(folders.repartition(max(1, -(-number // FOLDERS_PER_TASK))), root), "listing")
        found = level.where("NOT is_folder").drop("is_folder")
        files = found if files is None else files.union(found)
        folders = level.where("is_folder").select("path")
        number = folders.count() if recursive else 0
    return files


def scan_corpus(
    spark: SparkSession, root: str, recursive: bool = False, any_case: bool = False
) -> DataFrame:
    """Supported files in a folder, or also below it if ``recursive``: ``path, file, kind, length, modificationTime``.

    Suffixes are lower case, unless ``any_case``.  Empty files are listed; their conversion is one of files that
    cannot be opened.
    """
    suffixes = [*w.PDF_SUFFIXES, *w.SLIDE_SUFFIXES, *w.IMAGE_SUFFIXES]
    file = F.element_at(F.split("path", "/"), -1)
    name = F.lower(file) if any_case else file
    wanted = [name.endswith(suffix) for suffix in suffixes]
    return _described(list_files(spark, root, recursive).where(reduce(Column.__or__, wanted)))


def read_corpus(
    spark: SparkSession, root: str, recursive: bool = False, any_case: bool = False
) -> DataFrame:
    """The same with ``content``, by Spark's binary file source.

    That source leaves out zero-length files and names that start with ``_`` or ``.``; contents are read only if
    that column is used.
    """
    root, glob = root.rstrip("/"), suffix_glob(any_case)
    below = _binary_files(spark).option("pathGlobFilter", glob)
    if recursive:
        return _described(below.load(root), "content")
    # a glob in the path itself does not go down into sub-folders
    try:
        return _described(_binary_files(spark).load(f"{root}/{glob}"), "content")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    # no such file; this fails in turn if there is no such folder
    return _described(below.load(root), "content").where(F.lit(False))


def read_texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``path, file, text`` of the files in a folder whose names end with ``suffix``, empty and hidden ones included.

    Listed and read by tasks, as `list_files` does it; texts are taken to be UTF-8.
    """
    root = qualified(spark, root.rstrip("/") or "/")
    listed = list_files(spark, root).where(F.col("path").endswith(suffix))
    number, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-number // FILES_PER_TASK), -(-size // BYTES_PER_TASK))

    def run(batches):
        import pyarrow as pa

        target, top = opened(root)
        scheme = root.removesuffix(top)

        def read(paths, texts):
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "content"])

        paths, texts, held = [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with target.open_input_stream(path.removeprefix(scheme), compression=None) as stream:
                    text = stream.read()
                paths.append(path)
                texts.append(text)
                held += len(text)
                if held >= READ_AT_ONCE:
                    yield read(paths, texts)
                    paths, texts, held = [], [], 0
        if paths:
            yield read(paths, texts)

    contents = listed.select("path").repartition(tasks).mapInArrow(run, "path string, content binary")
    return contents.select("path", n.file_name(F.col("path")).alias("file"), F.col("content").cast("string").alias("text"))


def scan_one(spark: SparkSession, path: str) -> DataFrame:
    """A single file of any suffix, whatever its case; a missing path is an error."""
    return _described(spark.read.format("binaryFile").load(path), "content")


def spread(table: DataFrame) -> DataFrame:
    """Deal a just-read table out to all cores if its files give fewer splits than that.

    A corpus of any size has more splits than cores and is left as it is; a few
    files with one row group each would keep most cores idle in text work.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores)


def path_ids(paths: DataFrame) -> DataFrame:
    """``doc_id, path``: the id is the path's SHA-256, so that no two files share one."""
    return paths.select(F.sha2("path", 256).alias("doc_id"), "path")


def distinct_sorted_paths(paths: DataFrame) -> DataFrame:
    """Each path once, ordered folder by folder."""
    return paths.select("path").distinct().orderBy(F.split("path", "/"))
