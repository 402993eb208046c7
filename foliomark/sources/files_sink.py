"""One file per row, committed as a whole: a Python data source for writing, and its writer.

Each task writes into staging folders of its own.  When all tasks are done, the files of the attempts that
count are moved to their names; if one fails for good, the staging folder goes and nothing was ever visible.

Spark keeps three pairs of Python processes on the driver for such a source, some 200 MB to look it up, to plan and to
commit; `sinks.write_files` uses the writer without them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .paths import opened

# Readers skip names that begin with an underscore.
STAGING = "_staging-"
# Files of a staging folder, which the commit lists and moves at once, and threads that do it.
MOVED_AT_ONCE, MOVERS = 1_000, 16


# A task's `Staged` as a row.
STAGED = "folder string, more int"


@dataclass
class Staged(WriterCommitMessage):
    """What a finished task leaves: its folder and how many more there are, never a list of its files."""

    folder: str
    more: int = 0

    def folders(self) -> Iterator[str]:
        return (_numbered(self.folder, number) for number in range(self.more + 1))


def _numbered(folder: str, number: int) -> str:
    return f"{folder}.{number}" if number else folder


class TextFiles(DataSource):
    """Rows ``file, text`` as UTF-8 files under a folder (option ``path``, with the scheme of its file system)."""

    @classmethod
    def name(cls) -> str:
        return "foliomark_text_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TextFilesWriter(self.options["path"])


class TextFilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.staging = folder.rstrip("/"), f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        from pyspark import TaskContext

        context = TaskContext.get()
        target, root = opened(self.folder)
        # another attempt at the same rows has another folder
        own = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        made, number, held = set(), 0, 0
        for batch in iterator:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if held == MOVED_AT_ONCE:
                    made, number, held = set(), number + 1, 0
                held += 1
                path = f"{root}/{_numbered(own, number)}/{file}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    target.create_dir(parent, recursive=True)
                    made.add(parent)
                with target.open_output_stream(path) as stream:
                    stream.write((text or "").encode("utf-8"))
        return Staged(own, number)

    def staged(self, batches: Iterator) -> Iterator:
        """`write`, for `mapInArrow`."""
        import pyarrow as pa

        done = self.write(batches)
        yield pa.RecordBatch.from_arrays([pa.array([done.folder]), pa.array([done.more], pa.int32())], names=["folder", "more"])

    def commit(self, messages: list) -> None:
        """Move the files to their names, folder by folder; then the staging folder goes.

        It holds the list of one staging folder at a time, however many files a task has written.  A commit that is
        cut off leaves files that are whole; the next run replaces them.
        """
        from pyarrow import fs

        target, root = opened(self.folder)

        def final_path(found) -> str:
            place = found.path.split(f"/{self.staging}/", 1)[1].split("/", 1)[1]
            return f"{root}/{place}"

        def move(found) -> None:
            final = final_path(found)
            if not isinstance(target, fs.LocalFileSystem) and target.get_file_info(final).type != fs.FileType.NotFound:
                target.delete_file(final)  # not every file system replaces a file when it moves another
            target.move(found.path, final)

        with ThreadPoolExecutor(MOVERS) as movers:
            for folder in (folder for message in messages if message is not None for folder in message.folders()):
                selector = fs.FileSelector(f"{root}/{folder}", recursive=True, allow_not_found=True)
                files = [found for found in target.get_file_info(selector) if found.type == fs.FileType.File]
                # a folder once for all its files
                for parent in {final_path(found).rpartition("/")[0] for found in files}:
                    target.create_dir(parent, recursive=True)
                list(movers.map(move, files))
        self._clear(target, root)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, target, root: str) -> None:
        from pyarrow import fs

        if target.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            target.delete_dir(f"{root}/{self.staging}")
