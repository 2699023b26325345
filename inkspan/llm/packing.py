"""Token-ID output: best-fit-decreasing packing into rows of equal length.

Documents become token ids by a vocabulary: that of a public byte-level BPE file (``ranked``), or UTF-8 bytes 0-255 and an
end mark (``BYTES``), or any function from a text to whole numbers. Ids are stored in 16 or 32 bits, as the vocabulary
says; an id that doesn't fit, or is below 0, is an error. A document longer than a row is split losslessly: whole rows,
then a rest. Segments are dealt by a hash to groups of about ``GROUP_TOKENS`` bytes of text, as many as the corpus needs,
so that a worker holds one group at a time whatever the corpus; within a group the longest segments are placed first,
each into the row with the least room that still holds it. That row is found by a segment tree over capacities in
log(row length) steps.

A packed row has its ids (little-endian, padded), the cumulative lengths of its segments, positions that start
again with each segment, and the documents and parts that stand in it, so that every document can be put together again.

Null texts count as empty: they give the end mark alone. Rows that repeat an id are segments in their own right. Other
columns are not read. An empty table gives no rows. A lost task is run again on its group and gives the same rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import narrow, text_slices

ROW, GROUP_TOKENS = 2048, 4_000_000
END, PAD = 256, 257


@dataclass(frozen=True)
class Vocabulary:
    """How a text becomes ids (without the end mark), the ids that end a document and fill a row, and bits of an id."""

    encode: Callable[[str], np.ndarray | list[int]]
    end: int = END
    pad: int = PAD
    bits: int = 16

    def __post_init__(self) -> None:
        if self.bits not in (16, 32):
            raise ValueError("ids have 16 or 32 bits")
        if not all(0 <= x < 1 << self.bits for x in (self.end, self.pad)):
            raise ValueError("the ids of end mark and padding don't fit")

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"<u{self.bits // 8}")

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text and the end mark, checked, as they are stored."""
        found = np.asarray(self.encode(text))
        if found.size and (found.dtype.kind not in "iu" or found.ndim != 1):
            raise ValueError("a text's ids must be a list of whole numbers")
        if found.size and (int(found.min()) < 0 or int(found.max()) >= 1 << self.bits):
            raise ValueError(f"an id doesn't fit into {self.bits} bits")
        return np.append(found.astype(self.kind), np.array(self.end, self.kind))


BYTES = Vocabulary(lambda text: np.frombuffer(text.encode(), np.uint8))
_built: dict[int, object] = {}


def ranked(path: str) -> Vocabulary:
    """The vocabulary of a file of byte-level BPE ranks; end mark and padding are the two ids after the last.

    The file is read here and sent to the workers, each of which builds its tables once.
    """
    import public_tokenizers

    pattern, data = public_tokenizers.PATTERN, Path(path).read_bytes()
    key, size = zlib.crc32(data), 1 + max(int(line.split()[1]) for line in data.splitlines())

    def encode(text: str) -> list[int]:
        found = _built.get(key)
        if found is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            found = _built[key] = tiktoken.Encoding(f"ranks-{key:08x}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return found.encode_ordinary(text)

    return Vocabulary(encode, size, size + 1, 16 if size + 1 < 1 << 16 else 32)


class Capacities:
    """Open rows by the room they have left: a segment tree whose nodes say whether any row below has that room."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = self.leaves + room
        while k and not self.any[k]:
            self.any[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``need``, which is taken out; the one added last, of several."""
        k = self.leaves + need
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k + (not self.any[2 * k])
        room = k - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[k] = 0
            k >>= 1
            while k:
                self.any[k] = self.any[2 * k] | self.any[2 * k + 1]
                k >>= 1
        return room, row


def best_fit(sizes: list[int], row: int) -> list[list[int]]:
    """Places of the sizes, which fall, in rows."""
    out: list[list[int]] = []
    open_rows = Capacities(row)
    for k, size in enumerate(sizes):
        found = open_rows.take(size)
        if found is None:
            found = row, len(out)
            out.append([])
        room, at = found
        out[at].append(k)
        if room > size:
            open_rows.add(room - size, at)
    return out


PACKED = "group int, row int, n_tokens int, ids binary, lengths array<int>, positions binary, doc_ids array<long>, parts array<int>"


def packed(docs: DataFrame, row: int = ROW, vocabulary: Vocabulary = BYTES) -> DataFrame:
    """Packed rows, see PACKED: ``lengths`` are cumulative and begin with 0, ``positions`` have as many bits as ``ids``."""
    kind, wide = vocabulary.kind, vocabulary.kind.itemsize

    def pack(batch: pa.RecordBatch, group: int) -> Iterator[dict]:
        data, docs_of, parts = (batch.column(c).to_pylist() for c in ("ids", "doc_id", "part"))
        for number, held in enumerate(best_fit([len(d) // wide for d in data], row)):
            sizes = [len(data[k]) // wide for k in held]
            ids = np.full(row, vocabulary.pad, kind)
            ids[: sum(sizes)] = np.frombuffer(b"".join(data[k] for k in held), kind)
            positions = np.zeros(row, kind)
            positions[: sum(sizes)] = np.concatenate([np.arange(s) for s in sizes])
            yield {"group": group, "row": number, "n_tokens": sum(sizes), "ids": ids.tobytes(), "lengths": [0, *np.cumsum(sizes).tolist()], "positions": positions.tobytes(), "doc_ids": [docs_of[k] for k in held], "parts": [parts[k] for k in held]}

    schema = pa.schema([("group", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("lengths", pa.list_(pa.int32())), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])
    return _by_group(docs, row, vocabulary, lambda batch, group: pa.RecordBatch.from_pylist(list(pack(batch, group)), schema), PACKED)


DIGEST = "group int, row int, n_segments int, n_tokens int, ids_sha256 string, lengths_crc32 long, positions_crc32 long, first_doc long"


def digests(docs: DataFrame, row: int = ROW, vocabulary: Vocabulary = BYTES) -> DataFrame:
    """The packed rows' digests, worked out where they are made, so that the matrices themselves need not be moved."""
    kind, wide = vocabulary.kind, vocabulary.kind.itemsize

    def pack(batch: pa.RecordBatch, group: int) -> Iterator[dict]:
        data, docs_of = batch.column("ids").to_pylist(), batch.column("doc_id").to_pylist()
        for number, held in enumerate(best_fit([len(d) // wide for d in data], row)):
            sizes = [len(data[k]) // wide for k in held]
            n = sum(sizes)
            ids = b"".join(data[k] for k in held) + vocabulary.pad.to_bytes(wide, "little") * (row - n)
            positions = np.concatenate([np.arange(s, dtype=kind) for s in sizes] + [np.zeros(row - n, kind)])
            lengths = np.concatenate(([0], np.cumsum(sizes))).astype("<i4")
            yield {"group": group, "row": number, "n_segments": len(held), "n_tokens": n, "ids_sha256": hashlib.sha256(ids).hexdigest(), "lengths_crc32": zlib.crc32(lengths.tobytes()), "positions_crc32": zlib.crc32(positions.tobytes()), "first_doc": docs_of[held[0]]}

    schema = pa.schema([("group", pa.int32()), ("row", pa.int32()), ("n_segments", pa.int32()), ("n_tokens", pa.int32()), ("ids_sha256", pa.string()), ("lengths_crc32", pa.int64()), ("positions_crc32", pa.int64()), ("first_doc", pa.int64())])
    return _by_group(docs, row, vocabulary, lambda batch, group: pa.RecordBatch.from_pylist(list(pack(batch, group)), schema), DIGEST)


def _by_group(docs: DataFrame, row: int, vocabulary: Vocabulary, pack: Callable[[pa.RecordBatch, int], pa.RecordBatch], schema: str) -> DataFrame:
    size = docs.agg((F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).alias("n")).first()["n"]
    groups = max(1, -(-size // GROUP_TOKENS))
    if row > 1 << vocabulary.bits:
        raise ValueError("positions of such long rows don't fit")
    wide = vocabulary.kind.itemsize

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            docs_of, parts, data, dealt = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = vocabulary.ids(text)
                for part, at in enumerate(range(0, len(ids), row)):
                    piece = ids[at : at + row].tobytes()
                    docs_of.append(doc)
                    parts.append(part)
                    data.append(piece)
                    dealt.append(xxhash.xxh64_intdigest(f"{doc} {part} {xxhash.xxh32_intdigest(piece)}") % groups)
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), pa.array(docs_of, pa.int64()), pa.array(parts, pa.int32()), pa.array([len(d) // wide for d in data], pa.int32()), pa.array(data, pa.binary())], ["group", "doc_id", "part", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and falling size; one group is held."""
        group, held = None, []
        for batch in batches:
            keys = batch.column("group").to_numpy()
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if len(part):
                    if held and keys[part[0]] != group:
                        yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0], int(group))
                        held = []
                    group = keys[part[0]]
                    held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0], int(group))

    parted = narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(segments, "group int, doc_id long, part int, n int, ids binary")
    parted = parted.repartition(groups, "group").sortWithinPartitions("group", F.desc("n"), "doc_id", "part", "ids")
    return parted.mapInArrow(run, schema)
