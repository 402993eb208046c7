"""SimHash near-dedup: fingerprints of word shingles, compared exactly tile by tile.

Distinct fingerprints are dealt into tiles of one population count each.  Two tiles meet only if their counts
differ by the radius at most; inside, runs of fingerprints with alike counts of their four quarters are
skipped in the same way, and the rest is compared by exclusive-or and bit count in numpy.  A task returns the
links that join its fingerprints (a forest), not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, fresh, named, stored
from .components import Forest, connected

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Fingerprints in a tile (128 KB), and in a run inside it.
TILE, RUN = 16_384, 256
#: Shingles whose bits are counted at once.
CHUNK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; 0 for a text without words, null included.

    A-Z is lower-cased, words are runs of anything but ASCII blanks, shingles count as often as they occur,
    and a text with fewer words than a shingle is one shingle.  A bit is set if more than half have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(words)) - 1
    first, after = starts[: len(words) - last], ends[last:]
    total, ones, digest = len(first), np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, total, CHUNK):
        part = [digest(joined[a:b], seed) for a, b in zip(first[i : i + CHUNK].tolist(), after[i : i + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed long."""

    def make(texts):
        return [[f - (1 << BITS) if f >> (BITS - 1) else f for f in map(fingerprint, texts)]]

    return append_columns(docs, [text], T.StructType([T.StructField(name, T.LongType())]), make)


def quarter_counts(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _runs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """``prints`` ordered by their quarters' counts, in runs with the least and most of each count."""
    counts = quarter_counts(prints)
    order = np.lexsort(counts.T[::-1])
    prints, counts = prints[order], counts[order]
    runs = [slice(i, min(i + RUN, len(prints))) for i in range(0, len(prints), RUN)]
    least = np.array([counts[r].min(axis=0) for r in runs], dtype=np.int16).reshape(-1, 4)
    most = np.array([counts[r].max(axis=0) for r in runs], dtype=np.int16).reshape(-1, 4)
    return prints, order, runs, least, most


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of one tile, or of two, within the radius."""
    a, _, runs_a, least_a, most_a = _runs(left)
    b, _, runs_b, least_b, most_b = (a, None, runs_a, least_a, most_a) if right is None else _runs(right)
    both = a if right is None else np.concatenate([a, b])
    shift, forest = 0 if right is None else len(a), Forest(len(both))
    for i, r in enumerate(runs_a):
        gaps = np.maximum(least_b - most_a[i], least_a[i] - most_b).clip(0).sum(axis=1)
        for j in np.flatnonzero(gaps <= radius):
            if right is None and j < i:
                continue
            x, y = np.nonzero(np.bitwise_count(a[r][:, None] ^ b[runs_b[j]][None, :]) <= radius)
            forest.join(x + r.start, y + runs_b[j].start + shift)
    rows, roots = forest.links()
    return both[rows], both[roots]


def fingerprint_components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """node and component for the fingerprints (column ``print``, distinct) that have a link."""
    ones = F.bit_count("print")
    counts = {r["ones"]: r["n"] for r in prints.groupBy(ones.alias("ones")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return prints.select(F.col("print").alias("node"), F.col("print").alias("component"))
    tiles = {p: -(-n // tile) for p, n in counts.items()}  # 65 numbers at most
    many = F.create_map(*(F.lit(x) for p, n in tiles.items() for x in (p, n)))
    # tile names: population count * 2^32 + number
    name = lambda p, k: F.shiftleft(p.cast("long"), 32) + k
    dealt = (
        prints.select("print", ones.alias("ones"))
        .withColumn("tile", name(F.col("ones"), F.pmod(F.xxhash64("print"), F.element_at(many, F.col("ones")))))
        .groupBy("ones", "tile")
        .agg(F.collect_list("print").alias("prints"))
    )
    dealt = checkpointed(dealt)
    partners = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(radius)),
            lambda d: F.transform(
                F.sequence(F.lit(1).cast("long"), F.coalesce(F.element_at(many, F.col("ones") + d), F.lit(0)).cast("long") + 1),
                lambda k: name(F.col("ones") + d, k - 1),
            ),
        )
    )
    # each sequence ends one past the last tile, which exists nowhere, so that it is never empty
    pairs = dealt.select("tile", "prints", F.explode(partners).alias("other")).where(F.col("other") >= F.col("tile"))
    met = pairs.join(dealt.select(F.col("tile").alias("other"), F.col("prints").alias("others")), "other")

    def compare(batches):
        for batch in batches:
            for own, x, other, y in zip(*(batch.column(c) for c in ("tile", "prints", "other", "others")), strict=True):
                left = np.asarray(x.values, dtype=np.int64).view(np.uint64)
                right = None if own == other else np.asarray(y.values, dtype=np.int64).view(np.uint64)
                a, b = tile_links(left, right, radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    # few rows, much work each: spread evenly over the tasks
    spread = met.select("tile", "prints", "other", "others").repartition(met.sparkSession.sparkContext.defaultParallelism * 4, "tile", "other")
    return connected(spread.mapInArrow(compare, "a long, b long"))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Rows whose fingerprints differ in ``radius`` bits at most are linked; component_id is the smallest id
    that a row reaches.  A null or blank text has fingerprint zero and is linked like any other.  Rows
    without id get the smallest id of their component, null if it has none.  Repeated rows come out as
    often as they come in; other columns are ignored; an empty table gives no rows.
    """
    rows = with_fingerprints(docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")), "text", "print").drop("text")
    rows = checkpointed(rows)
    prints = checkpointed(rows.groupBy("print").agg(F.min("doc_id").alias("least_id")))
    labels = _labelled(prints, radius)
    return rows.join(labels, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(prints: DataFrame, radius: int) -> DataFrame:
    """print and component_id: the smallest least_id of its component."""
    linked = fingerprint_components(prints.select("print"), radius)
    marked = checkpointed(
        prints.join(linked.withColumnRenamed("node", "print"), "print", "left").select(
            "print", "least_id", F.coalesce("component", "print").alias("component")
        )
    )
    least = marked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return marked.join(least, "component").select("print", "component_id")


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (nulls last).

    Of several such rows it is the first in the stored order; so of repeated rows, one stays.  Null, empty and blank
    texts share the fingerprint zero and so are one component; other columns are kept; an empty table gives no rows.
    """
    mark, row, component, chosen = fresh(docs, "print_", "row_", "component_", "chosen_")
    kept = stored(with_fingerprints(docs, text, mark).withColumn(row, F.monotonically_increasing_id()), "simhash-documents")
    rank = F.struct(named(doc_id).isNull().alias("missing"), named(doc_id).alias("id"), F.col(row).alias("row"))
    prints = checkpointed(kept.groupBy(F.col(mark).alias("print")).agg(F.min(rank).alias("least_id")))
    first = _labelled(prints, radius).select(F.col("component_id.row").alias(chosen)).distinct()
    return kept.join(first, kept[row] == first[chosen], "left_semi").select(*(kept[f"`{c}`"] for c in docs.columns))

