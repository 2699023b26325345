"""Embedding near-dedup by an epsilon grid order join: vectors whose cosine is at least 0.9, found exactly.

Unit vectors have a cosine of at least c if and only if they lie within epsilon = sqrt(2 - 2c). Vectors are turned on to
their principal axes (moments of all vectors), and sorted by the cells of an epsilon grid on the leading axes. The sorted
sequence is cut into strips of ``STRIP`` vectors, each with a bounding box on all axes. Intervals of strips are joined
recursively, from the whole sequence down, and pairs whose boxes are further apart than epsilon are skipped: each level
is a DataFrame of interval pairs. Each surviving pair of strips is a tile, where blocks are skipped the same way and the
rest are compared in double precision. A tile returns the number of links of each vector and a spanning forest.

Turning is a rotation, so distances and the proof hold on any axes; only the skipping gets better with good ones. In many
dimensions without structure little can be skipped and the work is that of all pairs of strips; memory is bounded by a
tile in any case. Copies (equal bytes) are collapsed first and counted.

Vectors of different lengths have no cosine and don't link. Each length is joined for itself: those of more than
``STRIP`` different vectors (or ``CELLS`` numbers) as said; of all others each length is one tile.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. A null vec_id links with
nothing and has a null component. An id that comes with several vectors stands for each of them: every row has the links
of its own vector, and n_links counts rows other than itself. An empty table gives an empty result. Other columns aren't
read. Vectors of floats are dealt out as floats and compared as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import stage, unstage
from inkspan.llm.components import components

COSINE = 0.9
#: Most vectors in a strip, and most numbers; vectors in a block; axes of the grid; intervals of the next level that one has.
STRIP, CELLS, LEAF, GRID_AXES, FAN = 8192, 4_000_000, 512, 8, 4
#: Cosines this near the bound are worked out again as the product over both lengths, in double precision.
CLOSE = 1e-9


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, length, fingerprint and bytes (numbers as stored) of vectors that take part; the others have null bytes."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                data, sizes = [], []
                for i, x in zip(batch.column("vec_id"), batch.column("embedding"), strict=True):
                    found = x.values.to_numpy(zero_copy_only=False) if x.is_valid and len(x) and i.is_valid and not x.values.null_count else None
                    fine = found is not None and np.isfinite(found).all() and found.any()
                    data.append((found + found.dtype.type(0)).tobytes() if fine else None)
                    sizes.append(len(found) if fine else 0)
                hashed = [xxhash.xxh3_128_intdigest(d) if d else 0 for d in data]
                two = np.array([(h >> 64, h & (1 << 64) - 1) for h in hashed], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(data, pa.binary())], ["vec_id", "size", "h1", "h2", "data"])

    as_stored = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long"), as_stored.alias("embedding")).mapInArrow(run, "vec_id long, size int, h1 long, h2 long, data binary")


def scaled(data: list[bytes], size: int) -> np.ndarray:
    """Vectors in double precision from the bytes of floats or doubles, each times a power of two (which is exact) to be near 1."""
    kind = np.float32 if data and len(data[0]) == 4 * size else np.float64
    x = np.frombuffer(b"".join(data), kind).reshape(-1, size).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(data: list[bytes], size: int) -> np.ndarray:
    x = scaled(data, size)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(reps: DataFrame, size: int) -> np.ndarray:
    """Axes by falling variance. The moments have size * (size + 1) cells, whatever the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column("data").to_pylist(), size)
                total[:size] += x.T @ x
                total[size] += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["at", "x"])

    rows = reps.select("data").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((size + 1) * size)
    for at, x in rows:
        total[at] = x
    total = total.reshape(size + 1, size)
    n = max(1.0, np.trace(total[:size]))
    mean = total[size] / n
    return np.linalg.eigh(total[:size] / n - np.outer(mean, mean))[1][:, ::-1]


def in_grid_order(reps: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """node, copies, h1, h2, data and strip: the node is a vector's place in the order of cells, strips are places over STRIP."""
    size = len(axes)
    turn = reps.sparkSession.sparkContext.broadcast(axes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = unit(batch.column("data").to_pylist(), size) @ turn.value
            cell = (np.floor(y[:, :GRID_AXES] / eps) + 128).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "copies", "data")), pa.array([r.tobytes() for r in cell], pa.binary()), pa.array(y[:, 0])], ["h1", "h2", "copies", "data", "cell", "lead"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    rows = reps.select("h1", "h2", "copies", "data").mapInArrow(cells, "h1 long, h2 long, copies long, data binary, cell binary, lead double")
    rows = rows.repartitionByRange("cell", "lead", "h1", "h2").sortWithinPartitions("cell", "lead", "h1", "h2").withColumn("part", F.spark_partition_id())
    rows = stage(rows.mapInArrow(number, "h1 long, h2 long, copies long, data binary, cell binary, lead double, part int, place long"), "ordered")
    starts = _starts(rows.groupBy("part").agg(F.count("*").alias("n")))
    at = F.col("start") + F.col("place")
    return rows.join(starts, "part").select(at.alias("node"), "copies", "h1", "h2", "data", F.floor(at / max(1, min(STRIP, CELLS // size))).cast("int").alias("strip"))


def _starts(counts: DataFrame) -> DataFrame:
    """Where each partition's places begin: running sums over as many rows as the sort has partitions."""
    rows = sorted(counts.collect())
    at, out = 0, []
    for part, n in rows:
        out.append((part, at))
        at += n
    return F.broadcast(counts.sparkSession.createDataFrame(out, "part int, start long"))


def boxes(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    """strip, lo, hi: bounds of each strip's turned vectors on all axes, as one array of partial bounds after another."""
    size = len(axes)
    turn = rows.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = unit(batch.column("data").to_pylist(), size) @ turn.value
            strip = batch.column("strip").to_numpy()
            found = np.unique(strip)
            lo, hi = (np.stack([f(y[strip == s], 0) for s in found]) for f in (np.min, np.max))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(list(lo), pa.list_(pa.float64())), pa.array(list(hi), pa.list_(pa.float64()))], ["strip", "lo", "hi"])

    return rows.select("strip", "data").mapInArrow(run, "strip int, lo array<double>, hi array<double>")


def _wider(boxed: DataFrame, key: Column, size: int) -> DataFrame:
    low = F.array(*(F.min(F.col("lo")[k]) for k in range(size))).alias("lo")
    return boxed.groupBy(key.alias("strip")).agg(low, F.array(*(F.max(F.col("hi")[k]) for k in range(size))).alias("hi"))


def _apart(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    gap = F.zip_with(F.zip_with(f"{a}_lo", f"{b}_hi", lambda x, y: x - y), F.zip_with(f"{b}_lo", f"{a}_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def strip_pairs(boxed: DataFrame, strips: int, eps: float, size: int) -> DataFrame:
    """(a, b), a <= b: strips that may hold linked vectors, by recursion over intervals of the sequence."""
    levels = [_wider(boxed, F.col("strip"), size)]
    while FAN ** len(levels) < max(strips, 2):
        levels.append(_wider(levels[-1], F.floor(F.col("strip") / FAN).cast("int"), size))
    levels = [stage(x, "boxes") for x in levels]
    pairs = boxed.sparkSession.createDataFrame([(i, j) for i in range(FAN) for j in range(i, FAN)], "a int, b int")
    for k in reversed(range(len(levels))):
        side = lambda x: levels[k].select(F.col("strip").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"))  # noqa: E731, B023
        pairs = stage(pairs.join(side("a"), "a").join(side("b"), "b").where(_apart("a", "b") <= eps * eps * (1 + 1e-9)).select("a", "b"), "pairs")
        if k:
            children = lambda x: F.explode(F.sequence(FAN * F.col(x), FAN * F.col(x) + FAN - 1))
            pairs = pairs.select(children("a").alias("a"), "b").select("a", children("b").alias("b")).where("a <= b")
    return pairs


def tile_links(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, raw: np.ndarray, axes: np.ndarray | None, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (copies counted) and local root of each vector; side 2: one strip. Blocks are skipped by their boxes on the axes."""
    norm = np.sqrt((raw * raw).sum(1))
    x = raw / norm[:, None]
    y = x if axes is None else x @ axes
    eps2 = (2 - 2 * bound) * (1 + 1e-9) + 1e-12
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    one = np.flatnonzero(side != 1)
    two = one if (side == 2).all() else np.flatnonzero(side == 1)
    cut = lambda rows: [(r, y[r].min(0), y[r].max(0)) for r in (rows[k : k + LEAF] for k in range(0, len(rows), LEAF))]
    blocks = cut(one), cut(two)
    for i, (r, lo, hi) in enumerate(blocks[0]):
        for j, (s, lo2, hi2) in enumerate(blocks[1]):
            if two is one and j < i:
                continue
            gap = np.maximum(np.maximum(lo2 - hi, lo - hi2), 0)
            if gap @ gap > eps2:
                continue
            c = x[r] @ x[s].T
            for a, b in np.argwhere(np.abs(c - bound) < CLOSE):
                c[a, b] = raw[r[a]] @ raw[s[b]] / (norm[r[a]] * norm[s[b]])
            hit = c >= bound
            if two is one and i == j:
                np.fill_diagonal(hit, False)
            links[r] += hit @ copies[s]
            if two is not one or i != j:
                links[s] += copies[r] @ hit
            for a in np.flatnonzero(hit.any(1)):
                near = np.unique(label[np.append(s[hit[a]], r[a])])
                if len(near) > 1:
                    label[np.isin(label, near[1:])] = near[0]
    return links, label


def joined(dealt: DataFrame, size: int | None, axes: np.ndarray | None, bound: float) -> DataFrame:
    """(node, root, links) of the vectors in each tile that link; dealt: tile, node, copies, side, data, sorted by tile.

    Without a size, a tile holds vectors of one length, whatever that is.
    """
    turn = dealt.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile; at most two strips are held."""

        def done(parts: list[pa.RecordBatch], tile: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            ids, copies, side = (t.column(c).to_numpy() for c in ("node", "copies", "side"))
            links, label = tile_links(ids, copies, side, scaled(t.column("data").to_pylist(), size or int(tile)), turn.value, bound)
            has = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[label[has]]), pa.array(links[has])], ["node", "root", "links"])

        tile, held = None, []
        for batch in batches:
            key = batch.column("tile").to_numpy()
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                if not len(part):
                    continue
                if held and key[part[0]] != tile:
                    yield done(held, tile)
                    held = []
                tile = key[part[0]]
                held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield done(held, tile)

    out = stage(dealt.mapInArrow(run, "node long, root long, links long"), "links")
    turn.destroy()
    return out


def by_strips(reps: DataFrame, size: int, bound: float) -> tuple[DataFrame, DataFrame]:
    """Vectors of one length as (node, h1, h2) and their links, by strips of the grid order."""
    eps = float(np.sqrt(2 - 2 * bound))
    axes = principal_axes(reps, size)
    rows = stage(in_grid_order(reps, axes, eps), "strips")
    strips = (rows.agg(F.max("strip")).first()[0] or 0) + 1
    pairs = strip_pairs(boxes(rows, axes), strips, eps, size)
    ends = pairs.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("strip"), F.lit(2).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("strip"), F.lit(0).alias("side")), F.struct(F.col("b").alias("strip"), F.lit(1).alias("side"))))), F.struct("a", "b").alias("tile"))
    dealt = rows.join(ends, "strip").select(F.xxhash64("tile.a", "tile.b").alias("tile"), "node", "copies", "side", "data")
    linked = joined(dealt.repartition("tile").sortWithinPartitions("tile"), size, axes, bound)
    return rows.select("node", "h1", "h2"), linked


def by_length(reps: DataFrame, bound: float) -> tuple[DataFrame, DataFrame]:
    """The same for lengths that have at most STRIP vectors each: a length is a tile. Nodes are below 0, others from 0 on."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by length: at most STRIP of each, so that a length and a place make a number."""
        size, at = None, 0
        for batch in batches:
            out = []
            for s in batch.column("size").to_pylist():
                size, at = s, at + 1 if s == size else 0
                out.append(-1 - (s * 2 * STRIP + at))
            yield batch.append_column("node", pa.array(out, pa.int64()))

    rows = reps.select(F.col("size").cast("long").alias("tile"), "size", "h1", "h2", "copies", "data").repartition("tile").sortWithinPartitions("tile", "h1", "h2")
    rows = stage(rows.mapInArrow(number, "tile long, size int, h1 long, h2 long, copies long, data binary, node long"), "short")
    dealt = rows.select("tile", "node", "copies", F.lit(2).alias("side"), "data").repartition("tile").sortWithinPartitions("tile")
    return rows.select("node", "h1", "h2"), joined(dealt, None, None, bound)


def classes(vectors: DataFrame, bound: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    found = stage(valid_vectors(vectors), "vectors")
    fine = found.where("data is not null")
    counted = stage(fine.groupBy("size", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("data").alias("data")), "reps")
    lengths = counted.groupBy("size").agg(F.count("*").alias("n"))
    large = sorted(r["size"] for r in lengths.where((F.col("n") > STRIP) | (F.col("n") * F.col("size") > CELLS)).select("size").collect())
    parts = [by_strips(counted.where(F.col("size") == size), size, bound) for size in large]
    small = counted.where(~F.col("size").isin(large)) if large else counted
    if not small.isEmpty():
        parts.append(by_length(small, bound))
    none = found.where("data is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = none
    for nodes, linked in parts:
        # A node's number says nothing about ids: a component is named after the smallest id of its nodes.
        roots = components(linked.select("node", "root").where("node <> root"))
        degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
        own = nodes.join(counted.select("h1", "h2", "rep", "copies"), ["h1", "h2"]).join(degree, "node", "left").join(roots.withColumnRenamed("root", "top"), "node", "left")
        own = stage(own.select("h1", "h2", "rep", F.coalesce("top", "node").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "own")
        names = own.groupBy("top").agg(F.min("rep").alias("component_id"))
        merged = stage(own.join(names, "top").select("h1", "h2", "n_links", "component_id"), "merged")
        for old in (linked, roots, own):
            unstage(old)
        out = out.unionByName(fine.select("vec_id", "h1", "h2").join(merged, ["h1", "h2"]).select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
