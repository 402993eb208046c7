"""WARC archives: written by Spark's text writer, read by a Python data source.

Writing: a record is one row of text whose line separator is the blank lines between records, so files go to
any store that Spark writes to.  Equal payloads are found by digest; one record holds the payload, the others
revisit it.

Reading: partitions are planned from the files' sizes; predicates on the record's type and headers are pushed
down; a record's headers are parsed first, and the payload of a record that isn't wanted is passed over
without being decoded.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from ..sources.paths import opened, qualified
from .common import checkpointed, named

RECORD_END = "\r\n\r\n"
PAGE = "<urn:x-page:%s>"
#: Repeated payloads' digests (some 60 bytes each) are broadcast up to so many, counted; else joined by shuffle.
BROADCAST_REPEATED = 200_000
#: Bytes of small files that one partition reads, and of records that are handed on at once.
PARTITION_BYTES, BATCH_BYTES = 64_000_000, 8_000_000
#: Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string,"
    " content_length long, payload_length long, headers map<string,string>, payload binary"
)
_HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}


def payload_digest(text: Column) -> Column:
    """Upper-case base32 SHA-1 of a text's UTF-8 bytes."""
    digest = F.sha1(text.cast("binary"))
    letters = []
    for k in range(8):  # five hex digits are four letters
        number = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.lit(BASE32).substr(F.shiftright(number, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every page."""
    payload = F.coalesce(named(html).cast("string"), F.lit(""))
    rows = pages.select(named(page_id).alias("page_id"), named(url).alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": payload_digest(F.col("payload"))}
    )
    repeated = checkpointed(
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("original"))
        .where("n > 1")
        .drop("n")
    )
    if repeated.count() <= BROADCAST_REPEATED:
        repeated = F.broadcast(repeated)
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def _header_value(text: Column) -> Column:
    """Without control characters, which would end the header."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]", " ")


def record_text(date: str) -> Column:
    """A record but for the two line ends after it, from the columns of `with_revisits`."""
    page = lambda c: F.concat(F.lit("<urn:x-page:"), _header_value(F.col(c)), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    length = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(RECORD_END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), page("page_id"),
        F.lit("\r\nWARC-Target-URI: "), _header_value(F.col("url")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Refers-To: "), page("refers_to"),
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(RECORD_END), block,
    )


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per page to gzipped files in ``folder``.

    A null payload is an empty one.  Of pages with equal payloads of ``least_bytes`` or more, the one with
    the smallest id (nulls last) is a response and the others are revisits of it; repeated rows of that id
    are responses too, and so are all pages of a payload that has no id at all.  Control characters in URLs
    become blanks; a null URL or id is an empty header.  Other columns are ignored; an empty table gives an
    archive without records.

    A file is one gzip stream, as Spark's text writer makes it, not a member for each record: it is read from its
    beginning, and a task reads whole files.
    """
    records = with_revisits(pages, page_id, url, html, least_bytes).select(record_text(date).alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").text(folder)


@dataclass
class Files(InputPartition):
    """Whole files that one task reads."""

    paths: tuple[str, ...]


def _headers(stream) -> dict[str, str] | None:
    """The next header lines by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    found: dict[str, str] = {}
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream, wanted: Sequence[tuple[str, frozenset[str]]], payload: bool) -> Iterator[tuple]:
    """Records of a stream with the wanted header values, as tuples of SCHEMA.

    A block that isn't needed is passed over in the stream; of a wanted one without payload, only the HTTP
    headers are read.
    """
    while (headers := _headers(stream)) is not None:
        length = int(headers.get("content-length", 0))
        if any(headers.get(name) not in values for name, values in wanted):
            stream.seek(length, io.SEEK_CUR)
            continue
        left, size, body = length, None, None
        if headers.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = stream.readline(left)
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":", 1)[1])
        if payload:
            body = stream.read(left)
        else:
            stream.seek(left, io.SEEK_CUR)
        yield (*(headers.get(h) for h in _HEADERS.values()), length, left if size is None else size, headers, body)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.wanted = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and membership on the columns that are headers; Spark does the others."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, EqualTo):
                self.wanted.append((_HEADERS[name], frozenset([f.value])))
            elif name in _HEADERS and isinstance(f, In):
                self.wanted.append((_HEADERS[name], frozenset(f.value)))
            elif not (name in ("record_type", "record_id") and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[Files]:
        """Whole files; small ones share a partition."""
        store, path = opened(self.path)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")
        planned: list[list[str]] = []
        room = 0
        for name, size in files:
            if size > room or not planned:
                planned.append([])
                room = PARTITION_BYTES
            planned[-1].append(name)
            room -= size
        return [Files(tuple(p)) for p in planned]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        kinds = [*[pa.string()] * 6, pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[8] = [list(h.items()) for h in columns[8]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for name in partition.paths:
            with io.BufferedReader(store.open_input_file(name), 1 << 20) as raw:
                stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                rows, held = [], 0
                for r in records(stream, self.wanted, self.payload):
                    rows.append(r)
                    held += 500 + len(r[-1] or b"")
                    if held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("path", folder)``, with the scheme of its file system; option payload=false
    leaves payloads out.

    Needs ``spark.sql.python.filterPushdown.enabled``: filters on headers are applied before payloads are read.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of the archives in ``folder``, which is resolved by Spark's default file system, as in `write_warc`.

    Sets ``spark.sql.python.filterPushdown.enabled`` in the session, which readers with pushdown need.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("path", qualified(spark, folder)).option("payload", str(payload).lower()).load()


def page_number(uri: Column) -> Column:
    """The id in a record's name; null if it is none."""
    return F.regexp_extract(uri, "<urn:x-page:(.*)>", 1).try_cast("long")
