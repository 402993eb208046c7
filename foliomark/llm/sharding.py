"""Sharding by minimax contiguous partition of ordered, atomic groups of equal texts.

Groups are ordered by the digest of their text.  The smallest capacity with which the groups, filled
greedily in this order, fit into the shards is found by binary search on a bounded outline of the order:
segments of groups whose digests begin alike, with their total sizes.  The outline is made finer only where a
cut may fall, by one aggregation over those parts of a sorted table, until the search is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_number, bucket_of, checkpointed, expand_copies, named, running_total, stored

#: Hex digits of a digest in the first outline (so 65,536 segments at most), and added with each refinement.
FIRST_DIGITS, MORE_DIGITS = 4, 2
DIGEST_DIGITS = 64


@dataclass
class Outline:
    """Segments in order: digest prefixes, sizes, and whether a segment is one group (atomic)."""

    prefixes: list[str]
    sizes: np.ndarray
    atomic: np.ndarray

    def __post_init__(self) -> None:
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])

    def fill(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        """The positions that greedy filling reaches after each shard.

        Cuts fall between segments; if ``anywhere``, also at any point inside a segment that isn't atomic,
        which is never worse than what its groups allow.
        """
        reached, at = [], 0
        for _ in range(shards):
            want = at + capacity
            k = int(np.searchsorted(self.ends, want, side="right")) - 1
            at = int(self.ends[k])
            if anywhere and k < len(self.sizes) and not self.atomic[k]:
                at = want
            reached.append(at)
        return reached

    def smallest(self, low: int, high: int, shards: int, anywhere: bool) -> int:
        """The smallest capacity from ``low`` to ``high`` that fits; ``high`` is known to fit."""
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, anywhere)[-1] >= self.ends[-1]:
                high = middle
            else:
                low = middle + 1
        return high

    def uncertain(self, low: int, high: int, shards: int) -> np.ndarray:
        """Segments to be refined: not atomic, and a cut may fall inside for a capacity in that range."""
        first, last = self.fill(low, shards, False), self.fill(high, shards, True)
        found = np.zeros(len(self.sizes), dtype=bool)
        for a, b in zip(first, last, strict=True):
            i, j = np.searchsorted(self.ends, a, side="right") - 1, np.searchsorted(self.ends, b, side="left")
            found[max(i, 0) : j] = True
        return found & ~self.atomic

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """The segment that each shard but the first begins with.

        Every shard holds ``capacity`` at most.  Within that, a cut falls as near as it can to an equal
        share of what is left, so that one huge group doesn't leave the other shards empty.
        """
        total, latest = int(self.ends[-1]), len(self.sizes)
        least = [latest]  # the first segment that the last k shards can hold from
        for _ in range(shards - 1):
            least.append(int(np.searchsorted(self.ends, self.ends[least[-1]] - capacity, side="left")))
        chosen, k = [], 0
        for left in range(shards - 1, 0, -1):
            at = int(self.ends[k])
            most = int(np.searchsorted(self.ends, at + capacity, side="right")) - 1
            goal = at + (total - at) / (left + 1)
            near = int(np.searchsorted(self.ends, goal))
            if near > 0 and (near >= len(self.ends) or goal - self.ends[near - 1] <= self.ends[near] - goal):
                near -= 1
            k = min(max(near, least[left], k), most)
            chosen.append(k)
        return chosen


def _outline(groups: DataFrame, digits: int) -> Outline:
    rows = (
        groups.groupBy(F.substring("digest", 1, digits).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"))
        .toPandas()
        .sort_values("prefix")
    )
    return Outline(list(rows["prefix"]), rows["size"].to_numpy(dtype=np.int64), rows["groups"].to_numpy() == 1)


def _refined(outline: Outline, where: np.ndarray, groups: DataFrame) -> Outline:
    """The outline with the marked segments, of one prefix length, cut finer.

    Only the row groups of the sorted table that hold them are read.
    """
    marked = np.flatnonzero(where)
    inside = F.lit(False)
    for run in np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1):  # neighbours are one range
        first, last = outline.prefixes[run[0]], outline.prefixes[run[-1]]
        inside |= (F.col("digest") >= first) & (F.col("digest") < last + "g")  # no digit comes after f
    digits = min(DIGEST_DIGITS, len(outline.prefixes[marked[0]]) + MORE_DIGITS)
    more, kept = _outline(groups.where(inside), digits), np.flatnonzero(~where)
    prefixes = [outline.prefixes[i] for i in kept] + more.prefixes
    sizes = np.concatenate([outline.sizes[kept], more.sizes])
    atomic = np.concatenate([outline.atomic[kept], more.atomic])
    order = sorted(range(len(prefixes)), key=prefixes.__getitem__)
    return Outline([prefixes[i] for i in order], sizes[order], atomic[order])


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Digest prefixes that the shards after the first begin with, and the smallest possible capacity.

    ``groups`` (digest, size) has one row per group and is best stored in the order of its digests.
    """
    outline = _outline(groups, FIRST_DIGITS)
    if not outline.prefixes:
        return [], 0
    low = max(-(-int(outline.ends[-1]) // shards), groups.agg(F.max("size")).first()[0])
    while True:
        high = outline.smallest(low, max(low, int(outline.ends[-1])), shards, False)
        low = outline.smallest(low, high, shards, True)
        unsure = outline.uncertain(low, high, shards)
        if low == high or not unsure.any():
            starts = outline.cuts(high, shards)
            return [outline.prefixes[k] if k < len(outline.prefixes) else "g" for k in starts], high
        lengths = np.array([len(p) for p in outline.prefixes])
        # a segment that doesn't fit at all hides where the cuts after it fall, so it comes first
        blocking = (outline.sizes > low) & ~outline.atomic
        unsure = blocking if blocking.any() else unsure
        outline = _refined(outline, unsure & (lengths == lengths[unsure].min()), groups)


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    A row's size is the UTF-8 length of its text plus 8.  Rows with equal texts are one group and share a
    shard; null counts as the empty text.  The largest shard is as small as contiguous filling allows (with
    a group larger than that share, as large as this group).  Slots count from 0 in each shard without gaps,
    in the order of a hash of id and text.  Null ids are ids like any other; repeated rows get a slot each.
    Other columns are ignored; an empty table gives no rows, and with few groups some shards stay empty.
    """
    content = F.coalesce(named(text), F.lit(""))
    rows = docs.select(
        named(doc_id).alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.sha2(content, 256).alias("digest"),
    )
    rows = checkpointed(rows.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("copies")))
    groups = rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("size"))
    groups = stored(groups.repartitionByRange("digest").sortWithinPartitions("digest"), "shard-groups")
    starts, _ = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("digest") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    place = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(1 << 32))
    keyed = rows.select(
        "*", shard.cast("int").alias("shard"), place.alias("place"), bucket_of(place, bucket_number(rows.count())).alias("bucket")
    )
    order = [F.col("place"), F.col("doc_id"), F.col("digest")]
    return expand_copies(running_total(keyed, "shard", "bucket", order, "copies", "before"), "copies", "copy").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("copy")).alias("slot")
    )
