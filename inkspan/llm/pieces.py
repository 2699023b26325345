"""SentencePiece encoding and decoding with n-best segmentation.

Pieces of a public model form a lattice over a text: an edge for every piece that stands at a place. Forward Viterbi
gives the best score from the start to every place; these scores are exact heuristics for a backward A-star search, which
therefore finds the n best segmentations in order without a detour.

No piece reaches over the border before a space mark, nor (in most models) from letters to other characters, so a text's
lattice falls into units (about words) whose best paths can be put together: the n best of the text differ from its best
in at most n - 1 units, which are among the n - 1 units with the smallest gap between their best and second best path.
Viterbi runs once for each distinct unit that a worker meets, A-star for those few.

Piece scores: the model's own ranks r stand for a Zipf distribution, log p = -log(r + SHIFT) - log(sum). Characters
without a piece become their UTF-8 bytes' pieces at BYTE_PENALTY below the rarest piece. Encoding is lossless: white
space is kept as it is, a space mark in the text itself goes by bytes.

Null and empty texts give no pieces and one segmentation with a score of 0; a text with fewer segmentations than n gives
those it has. Log probabilities are multiples of 1 / STEPS, so that sums are exact and ties are ties; they go to the path that
is nearest its end, then to the one met first, and among units with equal gaps to those that stand first, so that results are the same on every
run. Repeated rows give equal rows. Columns other than doc_id and text are not read. Each row stands alone: nothing is
shuffled, memory is bounded by a slice of texts and MOST_KEPT units of at most LONG_UNIT characters; longer units (a
text without spaces may be one) are worked out whenever they are met, in memory that grows with their length.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import narrow, text_slices

MARK, OWN_MARK = "▁", "\ud800"
SHIFT, BYTE_PENALTY = 2.7, 10.0
#: Segmentations for each text; units whose paths a worker keeps.
BEST, MOST_KEPT, LONG_UNIT = 4, 250_000, 64
STEPS = 1 << 20


def unit_pattern(pairs: set[str]) -> str:
    """A pattern for units no piece of which reaches into another, given all pairs of neighbours within pieces.

    Where letters and other characters never stand together in a piece (but for a few odd characters, which then don't
    count as letters), runs of letters are units of their own: these recur far more often than words with their marks.
    """
    is_letter = re.compile(r"[^\W\d_]").match
    mixed = [p for p in pairs if p[0] != MARK and bool(is_letter(p[0])) != bool(is_letter(p[1]))]
    odd = "".join(sorted({c for p in mixed for c in p if is_letter(c) and not c.isalpha()}))
    if any(not any(c in odd for c in p) for p in mixed):
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
    letter = f"[^\\W\\d_{re.escape(odd)}]"
    return f"{MARK}*(?:{letter}+|(?:(?!{letter})[^{MARK}])+)|{MARK}+"


@dataclass
class Model:
    """Pieces by text, their log probabilities, and the bytes each id stands for."""

    ids: dict[str, int]
    logp: list[float]
    bytes_of: list[bytes]
    byte_ids: list[int]
    longest: int = field(init=False)
    #: Pieces by character: the log probability of the piece that ends there or 0, and what goes on from there or None; the pattern
    #: of units; paths that this process has found.
    tree: dict[str, tuple[float, dict | None]] = field(init=False)
    units: re.Pattern = field(init=False)
    known: dict = field(default_factory=dict, init=False)
    older: dict = field(default_factory=dict, init=False)
    more: dict = field(default_factory=dict, init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids))
        self.tree = {}
        for p in sorted(self.ids, key=len, reverse=True):  # the longest first: what goes on from a piece is there before it
            level = self.tree
            for c in p[:-1]:
                w, below = level.get(c, (0.0, None))
                if below is None:
                    below = {}
                    level[c] = w, below
                level = below
            level[p[-1]] = self.logp[self.ids[p]], level.get(p[-1], (0.0, None))[1]
        self.units = re.compile(unit_pattern({p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}))

    @classmethod
    def load(cls, path: str) -> Model:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        ids, ranks, table, low = {}, {}, [b""] * size, [0] * 256
        for i in range(size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                low[int(piece[3:5], 16)] = i
                table[i] = bytes((int(piece[3:5], 16),))
            elif not (m.is_control(i) or m.is_unknown(i)):
                ids[piece] = i
                ranks[i] = min(float(-m.get_score(i)), size)
                table[i] = piece.replace(MARK, " ").encode()
        return cls.of(ids, ranks, table, low)

    @classmethod
    def of(cls, ids: dict[str, int], ranks: dict[int, float], table: list[bytes], low: list[int]) -> Model:
        total = np.log(sum(1 / (max(r, 0) + SHIFT) for r in ranks.values()))
        logp = [-np.inf] * len(table)
        for i, r in ranks.items():
            logp[i] = round(float(-np.log(max(r, 0) + SHIFT) - total) * STEPS) / STEPS
        rare = min(logp[i] for i in ranks) - BYTE_PENALTY
        for i in low:
            logp[i] = float(rare)
        return cls(ids, logp, table, low)

    def viterbi(self, unit: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of the best path, and the gap to the second best (infinite without one)."""
        n, get = len(unit), self.tree.get
        best, second, back = [-np.inf] * (n + 1), [-np.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            one, two, j = best[i], second[i], i + 1
            w, below = get(unit[i], (0.0, None))
            if not w:
                w = self._bytes(unit[i])[0]
            while True:
                if w:
                    s, b = one + w, best[j]
                    if s > b:
                        best[j], back[j] = s, i
                        second[j] = b if b > two + w else two + w
                    elif s > second[j]:
                        second[j] = s
                if below is None or j == n:
                    break
                found = below.get(unit[j])
                if found is None:
                    break
                w, below = found
                j += 1
        ids, get, j = [], self.ids.get, n
        while j:
            i = back[j]
            k = get(unit[i:j])
            if k is None:
                ids += reversed(self._bytes(unit[i])[1])
            else:
                ids.append(k)
            j = i
        ids.reverse()
        return best[n], tuple(ids), best[n] - second[n]

    def _bytes(self, c: str) -> tuple[float, list[int]]:
        """Score and ids of a character by its bytes."""
        ids = [self.byte_ids[b] for b in (MARK if c == OWN_MARK else c).encode()]
        return sum(self.logp[k] for k in ids), ids

    def ending(self, unit: str, j: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """What ends at a place: (start, score, ids)."""
        out = []
        for i in range(max(0, j - self.longest), j):
            k = self.ids.get(unit[i:j])
            if k is not None:
                out.append((i, self.logp[k], (k,)))
            elif i == j - 1:
                score, ids = self._bytes(unit[i])
                out.append((i, score, tuple(ids)))
        return out

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths in order: A-star from the end, forward Viterbi scores being the rest's exact scores.

        What an entry of the agenda promises is the score of a path, and no two entries stand for the same path: what
        promises less than the n best of them is never followed. Of equal promises that nearest to its end goes on.
        """
        ahead = [0.0]
        for j in range(1, len(unit) + 1):
            ahead.append(max(ahead[i] + s for i, s, _ in self.ending(unit, j)))
        whole, order = ahead[-1], count()
        agenda: list[tuple[float, int, int, float, tuple]] = [(0.0, len(unit), next(order), 0.0, ())]
        least = [0.0]
        out: list[tuple[float, tuple[int, ...]]] = []
        while agenda and len(out) < n:
            loss, j, _, done, path = heapq.heappop(agenda)
            if not j:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            least.remove(loss)
            for i, s, ids in self.ending(unit, j):
                now = whole - ahead[i] - s - done
                if len(least) < n or now < least[-1]:
                    bisect.insort(least, now)
                    del least[n:]
                    heapq.heappush(agenda, (now, i, next(order), s + done, (ids, path)))
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])[1:].decode(errors="replace")


def units_of(text: str, units: re.Pattern) -> list[str]:
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, OWN_MARK)
    return units.findall(MARK + text.replace(" ", MARK))


class Encoder:
    """Encodes slices of texts; keeps the paths of at most MOST_KEPT units."""

    def __init__(self, model: Model, n: int = BEST) -> None:
        self.model, self.n = model, n

    def paths(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        more = self.model.more
        if len(unit) > LONG_UNIT:
            return self.model.n_best(unit, self.n)
        found = more.get((unit, self.n))
        if found is None:
            if len(more) >= MOST_KEPT // 8:
                more.clear()
            found = more[unit, self.n] = self.model.n_best(unit, self.n)
        return found

    def path(self, unit: str) -> tuple[float, tuple[int, ...], float]:
        """Paths of units met lately are kept in two generations, so that common units outlive rare ones."""
        known, older = self.model.known, self.model.older
        if len(unit) > LONG_UNIT:
            return self.model.viterbi(unit)
        found = known.get(unit)
        if found is None:
            found = older.pop(unit, None) or self.model.viterbi(unit)
            if len(known) >= MOST_KEPT // 2:
                older.clear()
                older.update(known)
                known.clear()
            known[unit] = found
        return found

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[float, dict[int, tuple[int, ...]]]], list[str]]]:
        """For each text: ids of the best path; the n best as (score, unit's place -> ids where it differs); the units."""
        index: dict[str, int] = defaultdict(count().__next__)
        split = [units_of(t, self.model.units) for t in texts]
        at = [np.fromiter(map(index.__getitem__, units), np.int64, len(units)) for units in split]
        known = self.model.known.get
        paths = [known(u) or self.path(u) for u in index]
        score = np.array([p[0] for p in paths])
        gap = np.array([p[2] for p in paths])
        sizes = np.array([len(p[1]) for p in paths], np.int64)
        flat = np.fromiter(chain.from_iterable([p[1] for p in paths]), np.int32, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        for units, k in zip(split, at, strict=True):
            if not units:
                yield np.zeros(0, np.int32), [(0.0, {})], units
                continue
            n = sizes[k]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids = flat[np.repeat(first[k], n) + inside]
            yield ids, self._several(units, gap[k], float(score[k].sum())), units

    def _several(self, units: list[str], gap: np.ndarray, best: float) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        most = self.n - 1
        near = np.flatnonzero(gap <= np.partition(gap, most - 1)[most - 1]) if 0 < most < len(gap) else np.arange(len(gap) if most else 0)
        near = near[np.argsort(gap[near], kind="stable")[:most]]
        found: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        for p in near[np.isfinite(gap[near])].tolist():
            ways = self.paths(units[p])
            tried = [(loss + ways[0][0] - s, {**swaps, p: ids} if w else swaps) for loss, swaps in found for w, (s, ids) in enumerate(ways)]
            found = sorted(tried, key=lambda x: x[0])[: self.n]
        return [(best - loss, swaps) for loss, swaps in found]

    def ids_of(self, units: list[str], swaps: dict[int, tuple[int, ...]]) -> list[int]:
        return [i for p, u in enumerate(units) for i in (swaps[p] if p in swaps else self.path(u)[1])]


def encode(docs: DataFrame, model: Model, n: int = BEST) -> DataFrame:
    """doc_id, ids of the best segmentation, the scores of the n best, and all of these segmentations' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, n)
        for batch in text_slices(batches):
            ids, scores, every = [], [], []
            for best, several, units in encoder.encode(batch.column("text").to_pylist()):
                ids.append(best)
                scores.append([s for s, _ in several])
                every.append([best.tolist(), *(encoder.ids_of(units, swaps) for _, swaps in several[1:])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64())), pa.array(every, pa.list_(pa.list_(pa.int32())))], ["doc_id", "ids", "scores", "n_best"])

    return narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, scores array<double>, n_best array<array<int>>")


def encode_best(docs: DataFrame, model: Model, n: int = BEST) -> DataFrame:
    """doc_id, ids of the best segmentation and the scores of the n best."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, n)
        for batch in text_slices(batches):
            found = [(best, [s for s, _ in several]) for best, several, _ in encoder.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))], ["doc_id", "ids", "scores"])

    return narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, scores array<double>")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id and the text that ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return narrow(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: Model, n: int = BEST) -> DataFrame:
    """doc_id, number and sha256 of the best ids, the n best scores, whether the ids give the text back; one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, n)
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            out = [(len(best), hashlib.sha256(best.astype("<i4").tobytes()).hexdigest(), [round(s, 6) for s, _ in several], shared.value.decode(best) == text) for text, (best, several, _) in zip(texts, encoder.encode(texts), strict=True)]
            types = (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", "n_pieces", "ids_sha256", "scores", "round_trip"])

    return narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, scores array<double>, round_trip boolean")
