"""Embedding near-dedup by sorted projection passes.

Vectors with the same direction are first made one node.  Each pass orders all nodes by the signs of their
projections on random directions, written one after the other, and compares every node with the neighbours in its
window; verified pairs of all passes are united into components.  Inside a component, links are then counted exactly.

How many passes there are follows from the number of nodes and the recall asked for.  That is for pairs that lie
alone; where vectors are dense a pass finds fewer.  So after each round of passes a sample of nodes is compared with
every node, block by block, and the share of their links that the components hold is measured; while it is too
small, more passes follow.  What none of MOST_ROUNDS rounds can reach is left to the exact way: every pair of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, named
from .components import Forest, connected

THRESHOLD = 0.9
#: Share of the links that the passes have to find.
RECALL = 0.999
#: Signs in a sort key of one pass.
HASHES, SEED = 64, 20_240_229
#: Nodes compared with each other at once, and how many of them the next such block begins with again.
BLOCK, OVERLAP = 2_048, 512
#: Rounds of passes before the exact way, and nodes that recall is measured with, about.
MOST_ROUNDS, SAMPLED = 4, 256
#: Nodes of a small component, many of which are counted in one task.
SMALL = 512
#: Bytes of a tile's vectors, and the fewest tiles that many nodes are spread over: in a component, and in all.
CELL_BYTES, COMPONENT_SPREAD, SPREAD = 32 << 20, 6, 16
#: Rows and columns of one matrix product.
ROWS, COLUMNS = 512, 4_096


def unit_vectors(vectors: Iterator) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors and their unit vectors; unusable are null, empty, zero, or hold null or
    non-finite components."""
    places, units = [], []
    for i, v in enumerate(vectors):
        if v is None:
            continue
        x = np.array([np.nan if c is None else c for c in v], dtype=np.float64)
        if not len(x) or not np.isfinite(x).all() or not x.any():
            continue
        x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
        places.append(i)
        units.append(x / np.sqrt(x @ x))
    return np.array(places, dtype=np.int64), units


def _packed(rows: DataFrame) -> DataFrame:
    """vec_id, dims, unit (the bytes of its doubles) and key (SHA-256 of both) of every row; null if unusable."""

    def run(batches):
        import hashlib

        for batch in batches:
            places, units = unit_vectors(batch.column("vector").to_pylist())
            dims, data, keys = [None] * len(batch), [None] * len(batch), [None] * len(batch)
            for i, u in zip(places.tolist(), units, strict=True):
                dims[i], data[i] = len(u), (u + 0.0).tobytes()  # one zero, not two
                keys[i] = hashlib.sha256(data[i]).digest()
            arrays = [batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(data, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "dims", "unit", "key"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, dims int, unit binary, key binary")


def _stacked(units: pa.Array | pd.Series, dims: int) -> np.ndarray:
    data = units.to_pylist() if isinstance(units, pa.Array) else units
    return np.frombuffer(b"".join(data), dtype=np.float64).reshape(-1, dims)


def passes_for(nodes: int, recall: float, threshold: float, overlap: int = OVERLAP) -> int:
    """Passes that put a lone pair at the threshold into one window with probability ``recall``.

    A pair agrees in one sign with probability 1 - angle / pi.  Its keys are neighbours closer than ``overlap`` if
    they agree in so many first signs that others rarely do.
    """
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    signs = max(0.0, math.log2(max(1, nodes) / overlap))
    found = agree**signs
    return 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))


def _projected(nodes: DataFrame, first: int, passes: int, hashes: int, seed: int) -> DataFrame:
    """node, pass and sort key (dims, then a bit for each sign) of every node, for passes from ``first`` on."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, sizes = np.asarray(batch.column("node")), np.asarray(batch.column("dims"))
            for dims in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dims)
                unit = _stacked(batch.column("unit").take(pa.array(own)), dims)
                if dims not in known:
                    drawn = [np.random.default_rng([seed, dims, first + k]).standard_normal((hashes, dims)) for k in range(passes)]
                    known[dims] = np.concatenate(drawn).T
                keys = np.packbits((unit @ known[dims] > 0).reshape(len(own), passes, hashes), axis=2)
                lead = int(dims).to_bytes(4, "big")
                arrays = [
                    pa.array(np.repeat(ids[own], passes)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(own))),
                    pa.array([lead + k.tobytes() for row in keys for k in row], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "pass", "key"])

    return nodes.select("node", "dims", "unit").mapInArrow(run, "node long, pass int, key binary")


def _blocks(projected: DataFrame, block: int, overlap: int) -> DataFrame:
    """node and block; the order by (pass, key) is cut into blocks that overlap."""
    ordered = checkpointed(
        projected.repartitionByRange("pass", "key", "node")
        .sortWithinPartitions("pass", "key", "node")
        .select("node", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    )
    # one row per partition is put in order, not the vectors
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    at = ordered.join(F.broadcast(offsets), "part").select("node", (F.col("row") + F.col("shift")).alias("at"))
    stride = block - overlap
    last = F.floor(F.col("at") / stride)
    first = F.greatest(F.lit(0), F.floor((F.col("at") - block) / stride) + 1)
    return at.select("node", F.explode(F.sequence(first, last)).alias("block"))


def _window_links(threshold: float):
    """Links that join a window's nodes.  They are found in single precision; a pair that this can't decide, and that
    no others join, comes out unsure."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, found = rows.drop_duplicates("node"), []
        for dims, own in rows.groupby("dims"):
            unit = np.stack([np.frombuffer(u, dtype=np.float32) for u in own["unit"]])
            ids, forest = own["node"].to_numpy(), Forest(len(own))
            doubt = 1e-6 + 2e-7 * dims
            near = unit @ unit.T
            x, y = np.nonzero(near >= threshold - doubt)
            x, y = x[x < y], y[x < y]
            sure = near[x, y] >= threshold + doubt
            forest.join(x[sure], y[sure])
            a, b = forest.links()
            found.append(pd.DataFrame({"a": ids[a], "b": ids[b], "sure": True}))
            x, y = x[~sure], y[~sure]
            apart = forest.roots(x) != forest.roots(y)
            found.append(pd.DataFrame({"a": ids[x[apart]], "b": ids[y[apart]], "sure": False}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "sure": []}).astype({"a": "int64", "b": "int64", "sure": bool})

    return run


def _verified(unsure: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs that are links in double precision."""

    def run(batches):
        for batch in batches:
            left, right, sizes = batch.column("u"), batch.column("v"), np.asarray(batch.column("dims"))
            good = np.zeros(len(sizes), dtype=bool)
            for dims in np.unique(sizes).tolist():
                own = pa.array(np.flatnonzero(sizes == dims))
                good[np.asarray(own)] = (_stacked(left.take(own), dims) * _stacked(right.take(own), dims)).sum(axis=1) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(good))

    one = nodes.select(F.col("node").alias("a"), "dims", F.col("unit").alias("u"))
    other = nodes.select(F.col("node").alias("b"), F.col("unit").alias("v"))
    return unsure.select("a", "b").distinct().join(one, "a").join(other, "b").mapInArrow(run, "a long, b long")


def _single(units: pd.Series) -> pd.Series:
    return units.map(lambda u: np.frombuffer(u, dtype=np.float64).astype(np.float32).tobytes())


def _pass_links(nodes: DataFrame, first: int, passes: int, hashes: int, block: int, overlap: int, seed: int, threshold: float) -> DataFrame:
    """a and b of the links that join what the windows of some passes hold."""
    half = F.pandas_udf(_single, "binary")
    short = nodes.select("node", "dims", half("unit").alias("unit"))
    met = _blocks(_projected(nodes, first, passes, hashes, seed), block, overlap).join(short, "node")
    links = checkpointed(met.groupBy("block").applyInPandas(_window_links(threshold), "a long, b long, sure boolean"))
    return checkpointed(links.where("sure").select("a", "b").union(_verified(links.where("NOT sure"), nodes, threshold)))


def measured_recall(nodes: DataFrame, joined: DataFrame, threshold: float, sampled: int = SAMPLED) -> float:
    """The share of a sample's links, compared with every node, whose ends have one component; 1 without links.

    The sample is the ``sampled`` nodes with the smallest hash, so its size doesn't grow; of each block of nodes
    only two numbers come back.
    """
    labelled = nodes.join(joined.select("node", "component"), "node", "left").select("node", "dims", "unit", F.coalesce("component", "node").alias("component"))
    rows = labelled.orderBy(F.xxhash64("node"), "node").limit(sampled).toPandas()
    sent = nodes.sparkSession.sparkContext.broadcast({d: (_stacked(g["unit"], d), g["node"].to_numpy(), g["component"].to_numpy()) for d, g in rows.groupby("dims")})

    def run(batches):
        for batch in batches:
            sizes, ids, component = (np.asarray(batch.column(c)) for c in ("dims", "node", "component"))
            every = held = 0
            for dims, (unit, own, label) in sent.value.items():
                at = np.flatnonzero(sizes == dims)
                near = _stacked(batch.column("unit").take(pa.array(at)), dims) @ unit.T >= threshold
                near &= ids[at, None] != own[None, :]
                every += int(near.sum())
                held += int((near & (component[at, None] == label[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([every]), pa.array([held])], names=["every", "held"])

    every, held = labelled.mapInArrow(run, "every long, held long").agg(F.sum("every"), F.sum("held")).first()
    return held / every if every else 1.0


def _alone_links(threshold: float):
    """Links (copies counted) of each member of small components with the others of its component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in rows.groupby(["component", "dims"]):
            unit, copies = _stacked(own["unit"], own["dims"].iat[0]), own["copies"].to_numpy()
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            found.append(pd.DataFrame({"node": own["node"], "links": near @ copies}))
        return pd.concat(found)

    return run


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """node and links (copies of others within the threshold) for the members of components.

    Small components share tasks; a larger one is dealt into tiles, and each pair of its tiles is one group of rows.
    So no task holds more than two tiles, and no pair is ever a row.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("widest"))
    tiles = F.greatest(F.ceil(F.col("n") * F.col("widest") * 8 / CELL_BYTES), F.least(F.lit(COMPONENT_SPREAD), F.ceil(F.col("n") / SMALL))).cast("int")
    tiled = checkpointed(members.join(sizes, "component").withColumn("tiles", F.when(F.col("n") > SMALL, tiles).otherwise(0)).drop("n", "widest"))
    alone = tiled.where("tiles = 0")
    bins = max(1, alone.count() // (4 * SMALL))
    small = alone.groupBy(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin")).applyInPandas(_alone_links(threshold), "node long, links long")
    large = _met(tiled.where("tiles > 0"), F.col("tiles")).groupBy("component", "low", "high").applyInPandas(_cell_links(threshold), "a long, b long, links long")
    return small.union(large.select("a", "links")).groupBy("node").agg(F.sum("links").alias("links"))


def _cell_links(threshold: float):
    """Links (copies counted) of the rows of one tile, or of two with each other, and the root that they reach."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dims, own in rows.groupby("dims"):
            unit = _stacked(own["unit"], dims)
            ids, copies, tile = (own[c].to_numpy() for c in ("node", "copies", "tile"))
            low, high = np.flatnonzero(tile == own["low"]), np.flatnonzero(tile == own["high"])
            same, forest, links = own["low"].iat[0] == own["high"].iat[0], Forest(len(own)), np.zeros(len(own), dtype=np.int64)
            for i in range(0, len(low), ROWS):
                a = low[i : i + ROWS]
                for j in range(i if same else 0, len(high), COLUMNS):
                    b = high[j : j + COLUMNS]
                    x, y = np.nonzero(unit[a] @ unit[b].T >= threshold)
                    x, y = a[x], b[y]
                    if same:  # each pair once
                        x, y = x[x < y], y[x < y]
                    np.add.at(links, x, copies[y])
                    np.add.at(links, y, copies[x])
                    forest.join(x, y)
            near = np.flatnonzero(links)
            found.append(pd.DataFrame({"a": ids[near], "b": ids[forest.roots(near)], "links": links[near]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")

    return run


def _met(nodes: DataFrame, tiles) -> DataFrame:
    """``nodes`` dealt into tiles, each tile once for every pair (low, high) that it is in."""
    dealt = nodes.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
    met = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return met.withColumns({"low": F.least("tile", "partner"), "high": F.greatest("tile", "partner")}).drop("partner")


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Of every node in every pair of tiles where it has links: itself (a), the root that it reaches (b), links.

    A tile's rows are sent once for every tile, so what is shuffled grows with their number.
    """
    n, dims = nodes.agg(F.count(F.lit(1)), F.max("dims")).first()
    tiles = max(-(-n * 8 * (dims or 1) // CELL_BYTES), min(SPREAD, -(-n // ROWS)), 1)
    met = _met(nodes.select("node", "copies", "dims", "unit"), F.lit(tiles))
    return met.groupBy("low", "high").applyInPandas(_cell_links(threshold), "a long, b long, links long")


def _found_by_passes(nodes: DataFrame, threshold: float, recall: float, passes: int | None, hashes: int, block: int, overlap: int, seed: int) -> DataFrame | None:
    """node and component by rounds of passes; None if they don't reach ``recall``."""
    n = nodes.count()
    each, links = passes or passes_for(n, recall, threshold, overlap), None
    for turn in range(1 if passes else MOST_ROUNDS):
        more = _pass_links(nodes, turn * each, each, hashes, block, overlap, seed, threshold)
        links = more if links is None else links.union(more)
        joined = checkpointed(connected(links))
        if passes or n <= block or measured_recall(nodes, joined, threshold) >= recall:
            return joined
        if turn:  # the first round knows lone pairs only; later ones double what there is
            each *= 2
    return None


def embedding_components(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
    recall: float = RECALL, passes: int | None = None, hashes: int = HASHES, block: int = BLOCK, overlap: int = OVERLAP, seed: int = SEED,
    exact: bool = False,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors with a cosine of ``threshold`` or more (in double precision) are linked; no pair below it ever is.  Links
    are those inside the components that the passes join, at least ``recall`` of all by the measure on a sample;
    ``passes`` sets their number instead, unmeasured.  ``exact`` compares every pair of vectors, at a cost that
    grows with the square of their number.

    n_links counts all linked others, copies included; component_id is the smallest id that links reach; kept
    says whether that is the row's own.  Vectors that are null, empty or zero or hold null or non-finite components
    have no link, nor do vectors of different lengths.  A row without id gets its component's smallest id and isn't
    kept.  Repeated rows are copies, and each comes out.  Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(named(vec_id).alias("vec_id"), named(embedding).cast("array<double>").alias("vector"))
    packed = _packed(rows)
    nodes = checkpointed(
        packed.where("key IS NOT NULL").groupBy("key")
        .agg(F.first("dims").alias("dims"), F.first("unit").alias("unit"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    joined = None if exact else _found_by_passes(nodes, threshold, recall, passes, hashes, block, overlap, seed)
    if joined is None:
        every = checkpointed(_all_links(nodes, threshold))
        joined = checkpointed(connected(every.select("a", "b")))
        counts = every.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    else:
        counts = _link_counts(joined.join(nodes.select("node", "dims", "unit", "copies"), "node"), threshold)
    named_ = joined.join(nodes.select("node", "least_id"), "node")
    least = named_.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = (
        nodes.select("key", "node", "copies", "least_id")
        .join(joined.join(least, "component").select("node", "component_id"), "node", "left")
        .join(counts, "node", "left")
        .select(
            "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        )
    )
    alone = F.col("key").isNull()
    return packed.select("vec_id", "key").join(found, "key", "left").select(
        "vec_id",
        F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(alone, True).otherwise(F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
