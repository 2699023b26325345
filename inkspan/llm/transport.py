"""Media columns: MPEG transport streams.

A payload of 8-bit samples is stored as a transport stream of 188-byte packets: a program association table, a
program map table, and one elementary stream (private data) whose packetized units carry a presentation timestamp and
begin at a random-access point. Reading parses the tables, checks every continuity counter, reassembles the units and
returns the timestamps and random-access points beside the payload.

Null texts count as empty; an empty text gives one frame of padding. Equal texts give equal rows, whatever else is in
the row. Columns of the input other than those named are ignored. Each row stands alone: nothing is shuffled, a lost
task is simply run again, and memory is bounded by one slice of texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkspan.llm.common import narrow, text_slices

PACKET, SYNC = 188, 0x47
FRAME = 576
#: Samples in one packetized unit, and its ticks of 90 kHz at 48,000 samples a second.
UNIT, TICKS = 16 * FRAME, 90_000 * 16 * FRAME // 48_000
PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE_DATA = 0x0000, 0x1000, 0x0100, 1, 0x06
#: The tables come again before every so many units.
TABLES_EVERY = 64
PES_HEAD, FIRST_ROOM, ROOM = 14, 176, 184


@cache
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        crc &= 0xFFFFFFFF
    return crc


@cache
def _table(pid: int) -> bytes:
    """The packet of the table that goes with pid, with a continuity counter of 0."""
    if pid == PAT_PID:
        body = struct.pack(">BHHBBBHH", 0x00, 0xB000 | 13, 1, 0xC1, 0, 0, PROGRAM, 0xE000 | PMT_PID)
    else:
        body = struct.pack(">BHHBBBHHBHH", 0x02, 0xB000 | 18, PROGRAM, 0xC1, 0, 0, 0xE000 | ES_PID, 0xF000, PRIVATE_DATA, 0xE000 | ES_PID, 0xF000)
    packet = struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + body + struct.pack(">I", crc32_mpeg(body))
    return packet.ljust(PACKET, b"\xff")


def _stamp(mark: int, ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes((mark << 4 | (ticks >> 29) & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1))


def mux(payload: bytes) -> bytes:
    """Stores a payload, a positive multiple of FRAME bytes, as a transport stream."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        if k % TABLES_EVERY == 0:
            for pid in (PAT_PID, PMT_PID):
                packet = bytearray(_table(pid))
                packet[3] |= tables & 15
                out.append(bytes(packet))
            tables += 1
        data = payload[at : at + UNIT]
        pes = b"\x00\x00\x01\xbd" + struct.pack(">HBBB", len(data) + 8, 0x84, 0x80, 5) + _stamp(2, k * TICKS) + data
        base = (k * TICKS) & ((1 << 33) - 1)
        clock = struct.pack(">IH", base >> 1, (base & 1) << 15 | 0x7E00)
        out.append(struct.pack(">BHBBB", SYNC, 0x4000 | ES_PID, 0x30 | counter, 7, 0x50) + clock + pes[:FIRST_ROOM])
        counter = counter + 1 & 15
        full, rest = divmod(len(pes) - FIRST_ROOM, ROOM)
        if full:
            rows = np.empty((full, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            rows[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            rows[:, 4:] = np.frombuffer(pes, np.uint8, full * ROOM, FIRST_ROOM).reshape(full, ROOM)
            out.append(rows.tobytes())
            counter = counter + full & 15
        if rest:
            room = ROOM - 1 - rest
            field = bytes((room,)) + (b"\x00" + b"\xff" * (room - 1) if room else b"")
            out.append(struct.pack(">BHB", SYNC, ES_PID, 0x30 | counter) + field + pes[-rest:])
            counter = counter + 1 & 15
    return b"".join(out)


class Stream:
    """What a transport stream holds: payload, timestamps, random-access units, and the number of counter errors."""

    def __init__(self, media: bytes) -> None:
        if not media or len(media) % PACKET:
            raise ValueError("not a whole number of packets")
        rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
        if (rows[:, 0] != SYNC).any():
            raise ValueError("a packet lacks its sync byte")
        pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
        start, kind, counter = (rows[:, 1] & 0x40) > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
        self.packets, self.errors = len(rows), 0
        for p in np.unique(pid):
            seen = counter[(pid == p) & (kind & 1 > 0)].astype(np.int16)
            self.errors += int(((np.diff(seen) & 15) != 1).sum())
        programs = self._sections(rows, pid, PAT_PID, lambda s: [(n, w & 0x1FFF) for n, w in struct.iter_unpack(">HH", s[8:-4])])
        self.pmt = next(p for n, p in programs if n)
        streams = self._sections(rows, pid, self.pmt, self._streams)
        self.kind, self.es = streams[0]
        own = pid == self.es
        rows, start, kind = rows[own], start[own], kind[own]
        has = kind & 2 > 0
        begin = np.where(has, 5 + rows[:, 4].astype(np.int32), 4)
        flags = np.where(has & (rows[:, 4] > 0), rows[:, 5], 0)
        data = rows[np.arange(PACKET) >= begin[:, None]]
        ends = np.cumsum(PACKET - begin)
        heads = np.flatnonzero(start)
        offsets = np.append(np.where(heads, ends[heads - 1], 0), len(data))
        self.random_access = [int(i) for i in np.flatnonzero(flags[heads] & 0x40)]
        self.timestamps, parts = [], []
        blob = data.tobytes()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if blob[a : a + 3] != b"\x00\x00\x01" or int.from_bytes(blob[a + 4 : a + 6], "big") != b - a - 6:
                raise ValueError("a unit is broken")
            s = blob[a + 9 : a + 14]
            self.timestamps.append((s[0] & 0x0E) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1)
            parts.append(blob[a + 9 + blob[a + 8] : b])
        self.payload = b"".join(parts)

    @staticmethod
    def _streams(section: bytes) -> list[tuple[int, int]]:
        at, out = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF), []
        while at < len(section) - 4:
            out.append((section[at], int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF))
            at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0x0FFF)
        return out

    @staticmethod
    def _sections(rows: np.ndarray, pid: np.ndarray, wanted: int, parse) -> list:
        found = None
        for row in np.unique(rows[pid == wanted][:, 4:], axis=0):
            data = row.tobytes()[1 + int(row[0]) :]
            section = data[: 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)]
            if crc32_mpeg(section):
                raise ValueError("a table's checksum is wrong")
            found = parse(section)
        if not found:
            raise ValueError("a table is missing")
        return found


def demux(media: bytes) -> Stream:
    return Stream(media)


def pad(data: bytes) -> bytes:
    """Appends bytes 255 up to a positive multiple of FRAME."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


MEDIA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("timestamps", T.ArrayType(T.LongType())),
        T.StructField("random_access", T.ArrayType(T.IntegerType())),
        T.StructField("cc_errors", T.IntegerType()),
    ]
)
DIGEST = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
)


def to_media(docs: DataFrame) -> DataFrame:
    """One transport stream per document, with its timestamps (ticks of 90 kHz), random-access units and counter errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.encode()
                media = mux(pad(data))
                s = demux(media)
                out.append((doc, len(data), media, s.timestamps, s.random_access, s.errors))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()), strict=True)], MEDIA.fieldNames())

    return narrow(docs).select("doc_id", "text").mapInArrow(run, MEDIA)


def from_media(media: DataFrame) -> DataFrame:
    """Reads streams back: doc_id, n_bytes, payload and what the tables and headers say, as digest columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, size, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                out.append(digest(doc, size, stored))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(DIGEST.fieldNames(), r, strict=True)) for r in out])

    return narrow(media).select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)


def digest(doc: int | None, size: int, media: bytes) -> tuple:
    s = demux(media)
    samples = np.frombuffer(s.payload, np.uint8)
    feature = f"pmt={s.pmt};type={s.kind};es={s.es};packets={s.packets};units={len(s.timestamps)};access={len(s.random_access)};errors={s.errors};pts={s.timestamps[0]}-{s.timestamps[-1]};mean={samples.mean():.6f};peak={int(samples.max())}"
    return doc, size, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores and reads back every text in one pass, so that no stream leaves the worker; the row of ``from_media(to_media(docs))``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in text_slices(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.encode()
                out.append(digest(doc, len(data), mux(pad(data))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], DIGEST.fieldNames())

    return narrow(docs).select("doc_id", "text").mapInArrow(run, DIGEST)
