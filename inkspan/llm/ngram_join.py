"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

The result is exact. Steps:

1. Shingles become 64-bit hashes; a document is the sorted array of its distinct ones. All shingles of the corpus, as
   packed runs of hashes (32 bits within a range) dealt by value, show which stand in two documents or more:
   ``SHARED_BITS`` places of two bits, whatever the corpus, say "in one only" or "perhaps shared" by few, by more or by
   many (``LEVELS``). A false answer costs time and nothing else.
2. In one order of all shingles (those in one document first, then by these classes, then by hash), two sets with a
   similarity of 0.8 share a member among the first fifth of each. What many documents share stands last, so that
   passages that are common but make up little of a text don't chain unrelated groups of copies to one family. A shingle of one document can't be it, so documents with a fifth of their own
   drop out; the others give the shared members of their first fifth as keys. Documents that share a key are chained to
   the key's first: at once within a block of ``KEYS`` rows, so that a key of very many documents is shuffled once for
   each block and not for each document, then over all. Components of these chains are families outside which no link
   can lie. Rows are 16 bytes and grow with the documents: no pairs.
3. Documents that belong to a family are read again and give their arrays, one for each distinct set. A small family is
   one tile. A large one is cut into size bands (a factor of 1.25, so that only neighbouring bands can link) and the
   bands into strips; each pair of strips is a tile. Tiles are bounded in documents and in shingles.
4. In a tile, hashed bitmap signatures bound the overlap of two sets from above by bit counts; what passes is decided by
   exact intersection of the sorted arrays. A tile returns a spanning forest of its links, never all pairs.
5. Components of the forests are the classes of documents.

Copies are collapsed before families are formed: equal sets have equal 128-bit fingerprints. Which documents have
arrays is looked up in a bitmap of ``FILTER_BITS`` bits, whatever the corpus; false hits only cost time.

Nulls: a null text counts as empty; empty sets link with nothing; a null doc_id stays null, is nobody's component, and
links with nothing. Rows with equal ids are rows in their own right. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import narrow, stage, text_slices, unstage, words_of
from inkspan.llm.components import components, solve, thinned

WORDS = 5
#: Links need NUMERATOR * overlap >= DENOMINATOR-th of the union: 100 * overlap >= 80 * union.
PERCENT = 80
#: Shingles of a block that is sorted at once; places that tell shared shingles; shingles that one task compares.
BLOCK, SHARED_BITS, RANGE = 1_500_000, 1 << 27, 2_000_000
#: Least numbers of sets of a shingle for the classes 1 to 3; class 0 is in one set only.
LEVELS = (2, 8, 64)
#: Rows of keys that a worker reduces at once.
KEYS = 500_000
_SHIFT = np.uint64(64 - SHARED_BITS.bit_length() + 1)
#: Most sets and most shingles of a strip; bits of the filter.
STRIP_SETS, STRIP_SHINGLES, FILTER_BITS = 2048, 4_000_000, 1 << 26

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than WORDS words, the whole sequence is the one shingle."""
    n = len(texts)
    rows, at, words = words_of(pc.ascii_lower(texts))
    if not len(at):
        return [np.zeros(0, np.uint64)] * n
    digest = xxhash.xxh3_64_intdigest
    hashed = np.fromiter((digest(w) for w in words), np.uint64, len(words))[at]
    ends = np.cumsum(np.bincount(rows, minlength=n))
    full = np.zeros(len(hashed), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            full[: len(hashed) - k] += hashed[k:] * _MULTIPLIERS[k]
        full = _mix(full)
        out, start = [], 0
        for end in ends.tolist():
            size = end - start
            if size >= WORDS:
                found = np.sort(full[start : end - WORDS + 1])
                out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
            elif size:
                out.append(_mix((hashed[start:end] * _MULTIPLIERS[:size]).sum(dtype=np.uint64, keepdims=True) + np.uint64(size)))
            else:
                out.append(np.zeros(0, np.uint64))
            start = end
    return out


def fingerprint(members: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(members.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(h >> 64), signed(h & (1 << 64) - 1)


def keys_of(members: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """The first of a set in the order of all shingles, as many as any partner must share one of; less those of its own."""
    n = len(members)
    at = (members >> _SHIFT).astype(np.int64)
    level = shared[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3
    both = level > 0
    wanted = n - -(-PERCENT * n // 100) + 1 - (n - int(both.sum()))
    return members[both][np.argsort(level[both], kind="stable")[:wanted]] if wanted > 0 else members[:0]


def shared_shingles(docs: DataFrame) -> np.ndarray:
    """SHARED_BITS places of two bits: the class of the shingles there; as bytes, collected by segments that don't overlap.

    What is dealt are 32 bits of a shingle within its range. Shingles that agree in them count as one, which makes them
    "perhaps shared": with RANGE shingles to a range that befalls fewer than one in a thousand.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, min(1 << 16, -(-size // 6 // RANGE)))
    width = -(-SHARED_BITS // ranges // 8) * 8
    ranges = -(-SHARED_BITS // width)
    borders = np.arange(1, ranges, dtype=np.uint64) * np.uint64(width) << _SHIFT
    dropped = max(0, int(_SHIFT) + (width - 1).bit_length() - 32)
    place = np.uint64(int(_SHIFT) - dropped)
    levels = np.array(LEVELS)

    def flush(block: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(block), return_counts=True)
        counts = np.minimum(counts, 255).astype(np.uint8)
        out: tuple[list, list, list] = [], [], []
        ends = [0, *np.searchsorted(found, borders).tolist(), len(found)]
        for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            near, n = ((found[i:j] - (np.uint64(k * width) << _SHIFT)) >> np.uint64(dropped)).astype(np.uint32), counts[i:j]
            for column, x in zip(out, (near[n == 1], near[n > 1], n[n > 1]), strict=True):
                column.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), *(pa.array(x, pa.binary()) for x in out)], ["range", "once", "more", "counts"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, np.ndarray] = {}
        size = 0
        for batch in text_slices(batches):
            for members in shingle_sets(batch.column("text")):
                if len(members) and (h := fingerprint(members)[0]) not in block:
                    block[h] = members
                    size += len(members)
            if size >= BLOCK:
                yield flush(list(block.values()))
                block, size = {}, 0
        if block:
            yield flush(list(block.values()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range; held are the hashes of one with their counts (low byte), added up whenever what is held has doubled."""

        def settle(held: list[np.ndarray]) -> None:
            every = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.concatenate(([True], every[1:] >> np.uint64(8) != every[:-1] >> np.uint64(8)))[: len(every)])
            counts = np.add.reduceat(every & np.uint64(255), new) if len(new) else every
            held[:] = [every[new] & ~np.uint64(255) | np.minimum(counts, np.uint64(255))]

        def done(number: int, held: list[np.ndarray]) -> pa.RecordBatch:
            settle(held)
            level = np.searchsorted(levels, (held[0] & np.uint64(255)).astype(np.int64), side="right")
            at = (held[0] >> np.uint64(8) >> place).astype(np.int64)
            found = np.zeros(width, np.uint8)
            for k in range(1, len(levels) + 1):
                found[at[level == k]] = k  # of several shingles at one place the commonest counts
            found = found.reshape(-1, 4)
            packed = found[:, 0] | found[:, 1] << 2 | found[:, 2] << 4 | found[:, 3] << 6
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["range", "bits"])

        number, held, size, settled = None, [], 0, RANGE
        for batch in batches:
            for r, a, b, n in zip(*(batch.column(c) for c in ("range", "once", "more", "counts")), strict=True):
                if r.as_py() != number:
                    if number is not None:
                        yield done(number, held)
                    number, held, size, settled = r.as_py(), [], 0, RANGE
                once, more = (np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) << np.uint64(8) for x in (a, b))
                held += [once | np.uint64(1), more | np.frombuffer(n.as_buffer(), np.uint8)]
                size += len(once) + len(more)
                if size > 2 * settled:
                    settle(held)
                    size = settled = len(held[0])
        if number is not None:
            yield done(number, held)

    rows = narrow(docs).select("text").mapInArrow(runs, "range int, once binary, more binary, counts binary").repartition(ranges, "range").sortWithinPartitions("range")
    out = np.zeros(ranges * width // 4, np.uint8)
    for batch in rows.mapInArrow(compare, "range int, bits binary").toArrow().to_batches():
        for number, bits in zip(batch.column("range").to_pylist(), batch.column("bits"), strict=True):
            out[number * width // 4 : (number + 1) * width // 4] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out


def families(docs: DataFrame) -> DataFrame:
    """(h1, family) for every set that may have a partner: components of shared prefix members."""
    shared = docs.sparkSession.sparkContext.broadcast(shared_shingles(docs))

    def reduced(key: np.ndarray, h1: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of a block, one row (key, h1) for each key and, as an edge, what the key joins within the block."""
        order = np.lexsort((h1, key))
        key, h1 = key[order], h1[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = h1[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        node, root = solve(h1, first)
        own = node != root
        x, y = np.concatenate((key[new], node[own])), np.concatenate((h1[new], root[own]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) >= new.sum()), pa.array(x), pa.array(y)], ["edge", "x", "y"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in text_slices(batches):
            seen: dict[int, np.ndarray] = {}
            for members in shingle_sets(batch.column("text")):
                if len(members):
                    h1 = fingerprint(members)[0]
                    if h1 not in seen:
                        seen[h1] = keys_of(members, shared.value)
            if seen:
                sizes = np.fromiter(map(len, seen.values()), np.int64, len(seen))
                key = np.concatenate(list(seen.values())).view(np.int64)
                held.append(np.stack((key, np.repeat(np.fromiter(seen, np.int64, len(seen)), sizes))))
                size += len(key)
            if size >= KEYS:
                yield from reduced(*np.concatenate(held, 1))
                held, size = [], 0
        if size:
            yield from reduced(*np.concatenate(held, 1))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and h1: each is joined to the first of its key. Memory: one row beside the batch."""
        last_key, leader = None, None
        for batch in batches:
            key, h1 = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            if not len(key):
                continue
            new = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(at >= 0, h1[np.maximum(at, 0)], leader if leader is not None else 0)
            last_key, leader = key[-1], first[-1]
            pairs = np.unique(np.stack((h1, first), 1)[h1 != first], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    rows = stage(narrow(docs).select("text").mapInArrow(keys, "edge boolean, x long, y long"), "keys")
    shared.destroy()
    chained = thinned(rows.where("not edge").select("x", "y").repartition("x").sortWithinPartitions("x", "y"), chain)
    found = components(chained.unionByName(thinned(rows.where("edge").select("x", "y"))), thin=False)
    out = stage(found.select(F.col("node").alias("h1"), F.col("root").alias("family")).unionByName(found.select(F.col("root").alias("h1"), F.col("root").alias("family")).distinct()), "families")
    for old in (rows, found):
        unstage(old)
    return out


def filter_of(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS bits in which each id has set one; at most FILTER_BITS / 64 rows come to the driver."""
    word = F.shiftrightunsigned(column, 6).bitwiseAND(F.lit(FILTER_BITS // 64 - 1))
    bit = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    table = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out


def sketches(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, n, fingerprint of every row, staged; the array too where the filter knows the set, once for each slice."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n, one, two, arrays, seen = [], [], [], [], set()
            for members in shingle_sets(batch.column("text")):
                h1, h2 = fingerprint(members)
                hit = len(members) and (h1, h2) not in seen and int(shared.value[(h1 >> 6) & (FILTER_BITS // 64 - 1)]) >> (h1 & 63) & 1
                if hit:
                    seen.add((h1, h2))
                n.append(len(members))
                one.append(h1)
                two.append(h2)
                arrays.append(members.tobytes() if hit else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(arrays, pa.binary())], ["doc_id", "n", "h1", "h2", "members"])

    out = stage(narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, members binary"), "sketches")
    shared.destroy()
    return out


@dataclass
class Tile:
    """Sets of one tile, in order of size; side 0 and 1 are two strips, of which only pairs across count, 2 is one strip."""

    ids: list[int]
    sides: list[int]
    sets: list[np.ndarray]

    def forest(self) -> list[tuple[int, int]]:
        order = sorted(range(len(self.ids)), key=lambda k: (len(self.sets[k]), self.ids[k]))
        ids, sets, side = [self.ids[k] for k in order], [self.sets[k] for k in order], np.array([self.sides[k] for k in order])
        n = np.array([len(s) for s in sets], np.int64)
        words = max(4, 1 << int(max(0, (2 * int(n.max()) - 1) // 64)).bit_length())
        words = min(words, 256)
        bits = np.zeros((len(sets), words), np.uint64)
        for k, s in enumerate(sets):
            hashed = s >> np.uint64(20)
            np.bitwise_or.at(bits[k], (hashed >> np.uint64(6)).astype(np.int64) & (words - 1), np.uint64(1) << (hashed & np.uint64(63)))
        filled = np.bitwise_count(bits).sum(1, dtype=np.int64)
        label = np.arange(len(sets))
        out = []
        for i in range(len(sets) - 1):
            end = int(np.searchsorted(n, 100 * n[i] // PERCENT, side="right"))
            if end <= i + 1:
                continue
            js = np.arange(i + 1, end)
            js = js[(label[js] != label[i]) & ((side[js] != side[i]) | (side[i] == 2))]
            if not len(js):
                continue
            common = np.bitwise_count(bits[js] & bits[i]).sum(1, dtype=np.int64)
            most = np.minimum(n[i] - filled[i] + common, n[js] - filled[js] + common)
            for j in js[(100 + PERCENT) * most >= PERCENT * (n[i] + n[js])].tolist():
                if label[j] == label[i]:
                    continue
                a, b = sets[i], sets[j]
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                overlap = int((b[at] == a).sum())
                if 100 * overlap >= PERCENT * (len(a) + len(b) - overlap):
                    out.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile and rep; a tile's sets are held until the next begins. Slices may have sent a set twice."""
    tile, held = None, Tile([], [], [])
    links: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    for batch in batches:
        for t, i, s, m in zip(*(batch.column(c).to_pylist() for c in ("tile", "rep", "side", "members")), strict=True):
            if t != tile:
                if len(held.ids) > 1:
                    links += held.forest()
                tile, held = t, Tile([], [], [])
            if held.ids and held.ids[-1] == i and held.sets[-1].tobytes() == m:
                continue
            held.ids.append(i)
            held.sides.append(s)
            held.sets.append(np.frombuffer(m, np.uint64))
        yield out()
        links = []
    if len(held.ids) > 1:
        links += held.forest()
    yield out()


def tiles(sets: DataFrame) -> DataFrame:
    """Deals sets (h1, h2, rep, family, n) to tiles; a set of a large family goes to each tile that holds its strip."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    sets = sets.withColumn("band", band)
    parts = F.ceil(F.greatest(F.count("*") / STRIP_SETS, F.sum("n") / STRIP_SHINGLES)).cast("int").alias("parts")
    whole = sets.groupBy("family").agg(parts)
    large = stage(whole.where("parts > 1").select("family"), "large")
    by_band = stage(sets.join(large, "family", "left_semi").groupBy("family", "band").agg(parts), "bands")
    near = by_band.select("family", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    under = by_band.select("family", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    plan = stage(by_band.join(near, ["family", "band"], "left").join(under, ["family", "band"], "left"), "plan")
    out = sets.join(plan, ["family", "band"], "left").withColumn("strip", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    tile = lambda kind, b, x, y: F.xxhash64("family", F.lit(kind), b, x, y)
    pair = lambda kind, b, x, y, side: F.struct(tile(kind, b, x, y).alias("tile"), side.cast("int").alias("side"))
    each = lambda n, f: F.when(n.isNull(), F.array().cast("array<struct<tile:bigint,side:int>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), f))
    b, s = F.col("band"), F.col("strip")
    within = each(F.col("parts"), lambda k: pair("in", b, F.least(s, k), F.greatest(s, k), F.when(s == k, 2).when(s < k, 0).otherwise(1)))
    up = each(F.col("above"), lambda k: pair("up", b, s, k, F.lit(0)))
    down = each(F.col("below"), lambda k: pair("up", b - 1, k, s, F.lit(1)))
    alone = F.array(F.struct(F.xxhash64("family").alias("tile"), F.lit(2).alias("side")))
    dealt = F.when(F.col("parts").isNull(), alone).otherwise(F.concat(within, up, down))
    return out.select("h1", "h2", "rep", F.inline(dealt).alias("tile", "side"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, itself included) for every row."""
    return _classes(docs)[0]


def _classes(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The classes, and the staged tables that they are read from."""
    family = families(docs)
    found = sketches(docs, filter_of(family, "h1"))
    reps = found.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = stage(reps, "reps")
    # What is dealt out is planned on slim rows; arrays are joined last and move twice. An array may stand on a row without
    # a doc_id, when a slice began with that copy; sets of which all rows are such have no rep and drop out here.
    slim = stage(found.where("members is not null").select("h1", "h2", "n").distinct().join(family, "h1").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]), "slim")
    planned = stage(tiles(slim), "tiles")
    dealt = found.where("members is not null").select("h1", "h2", "members").join(planned, ["h1", "h2"]).select("tile", "rep", "side", "members")
    roots = components(thinned(dealt.repartition("tile").sortWithinPartitions("tile", "rep"), _forests), thin=False)
    merged = stage(reps.join(roots, reps["rep"] == roots["node"], "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"), "copies"), "merged")
    for old in (family, reps, slim, planned, roots):
        unstage(old)
    has = found.where("n > 0 and doc_id is not null").select("doc_id", "n", "h1", "h2").join(merged, ["h1", "h2"])
    has = has.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "copies")
    none = found.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    return has.unionByName(none), [found, merged]


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less those of documents whose class holds a smaller id; null ids stay.

    Texts are not shuffled: a bitmap tells ids that stay for certain, and only rows of the others are joined.
    """
    found, read = _classes(docs)
    gone = stage(found.where("doc_id > component_id").select("doc_id").distinct(), "gone")
    for old in read:
        unstage(old)
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(gone, "doc_id"))

    def rows(hit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index("doc_id"))
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                k = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = known & ((shared.value[(k >> 6) & (FILTER_BITS // 64 - 1)] >> (k & 63) & 1) > 0)
                yield batch.filter(pa.array(found == hit))

        return narrow(docs).mapInArrow(run, docs.schema)

    return rows(False).unionByName(rows(True).join(gone, "doc_id", "left_anti").select(*docs.columns))
