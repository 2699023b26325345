"""Toxicity by noisy-channel deobfuscation.

What a writer meant is read back from what was written: every token that shows signs of disguise (digits or symbols
for letters, characters drawn out, letters spaced apart) becomes a lattice of characters, and Viterbi finds its most
probable path under a character trigram language model. Restored words are then scored: words whose share of toxic
documents is far above that of others carry log odds, a document sums those of its distinct words, and a logistic
curve turns the sum into a probability.

The language model counts every text of the corpus; its table has ``SYMBOLS ** 3`` cells whatever the corpus. Word
evidence is learnt from at most ``TRAIN_ROWS`` labelled documents, hashed into ``BUCKETS``. Nothing else is gathered;
texts are never shuffled, and each is read whole.

Null and empty texts have no evidence: they score the base value. Without labels every score is 0. Repeated rows score
alike. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import crc32_mod, labelled_sample, narrow, text_slices, words_of

#: Letters of the language model (0: the border of a word), most labelled rows to learn from, buckets of word evidence.
LETTERS, SYMBOLS = "abcdefghijklmnopqrstuvwxyz", 27
TRAIN_ROWS, BUCKETS = 20_000, 1 << 18
#: A word is evidence if it is so many times likelier under one label and its count so many deviations from chance.
LIFT, DEVIATIONS = 4.0, 6.0
#: What a symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("асеіјорѕухвкмнтαεικορτυχ", "aceijopsyxbkmhtaeikoptux", strict=True))
HIDDEN = "­​‌‍⁠﻿"
#: Costs (negative log probabilities) of channel steps: a symbol for a letter, one that hides a letter, a symbol that may
#: stand for letters but stands for none, one that only separates, a letter drawn out. What is left out costs about as
#: much as the language model would charge for a letter, so that paths of unequal length compare.
SWAP, MASK, DROP, APART, DRAWN = 1.0, 2.0, 9.0, 0.2, 6.0


def _folds() -> dict[int, str | None]:
    """Lower case without accents, for letters up to U+024F and their full-width forms, by rule."""
    table: dict[int, str | None] = {ord(c): None for c in HIDDEN} | {ord(a): b for a, b in ALIKE.items()}
    for code in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0xFF21, 0xFF5B)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if not unicodedata.combining(c))
        if base and base != chr(code):
            table[code] = base
    return table | {ord("ß"): "ss", ord("ø"): "o", ord("æ"): "ae", ord("œ"): "oe", ord("ł"): "l"}


FOLDS = _folds()
_CLASS = np.zeros(0x250, np.int16)
for _code in range(0x250):
    _base = chr(_code).translate(FOLDS)[:1]
    _CLASS[_code] = LETTERS.find(_base) + 1 if _base else 0

#: At the ends of a token: sentence marks and brackets (at its end "!" too); symbols there go if they are repeated.
MARKS = frozenset(".,;:?\"'()[]{}«»„“”")
THRICE = re.compile(r"(.)\1\1")
TWICE = re.compile(r"(.)\1+")
#: Hidden letters of a token that are guessed (further ones only separate); characters after which a path is settled if
#: all paths have met, and in any case. A space that was put into a word costs JOINED; in runs of single letters, nothing.
MASKS, MET, SPAN, JOINED = 8, 64, 512, 7.0
_PLACE = {c: k + 1 for k, c in enumerate(LETTERS)}


def trimmed(token: str) -> str:
    """A token without its edges; linear in its length."""

    def runs(at: range, marks: frozenset) -> int:
        """How many characters along ``at`` are edges."""
        k, n = 0, len(at)
        while k < n:
            c = token[at[k]]
            end = k + 1
            if c not in marks:
                while end < n and token[at[end]] == c:
                    end += 1
                if end == k + 1 or c.isalnum() or c == "_" or c.isspace():
                    break
            k = end
        return k

    start = runs(range(len(token)), MARKS)
    return token[start : len(token) - runs(range(len(token) - 1, start - 1, -1), MARKS | {"!"})]


def trigram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of letter trigrams; whatever is no letter is a border."""
    codes = np.frombuffer("\n\n".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    kind = _CLASS[np.minimum(codes, 0x24F)]
    kind[codes > 0x24F] = 0
    kind = np.concatenate(([0, 0], kind, [0])).astype(np.int32)
    return np.bincount((kind[:-2] * SYMBOLS + kind[1:-1]) * SYMBOLS + kind[2:], minlength=SYMBOLS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(third | first two) over all texts of ``docs``; SYMBOLS ** 3 rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in text_slices(batches):
            total += trigram_counts(batch.column("text"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["at", "n"])

    counts = np.zeros(SYMBOLS**3)
    for at, n in narrow(docs).select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[at] = n
    return model_of(counts)


def model_of(counts: np.ndarray) -> np.ndarray:
    """Trigram shares, backed by bigram shares, backed by even ones."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c2 = c3.sum(0)
    p2 = (c2 + 1) / (c2 + 1).sum(1, keepdims=True)
    return np.log((c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5))


_flat: tuple[np.ndarray | None, list[float]] = (None, [])


def _table(lm: np.ndarray) -> list[float]:
    """The language model as a flat list, which is read faster; that of the last model is kept."""
    global _flat
    if _flat[0] is not lm:
        _flat = lm, lm.ravel().tolist()
    return _flat[1]


def steps_of(c: str, before: str, masks: int) -> list[tuple[int, float]]:
    """What a character may stand for: (letter's number, -1 for nothing, 0 for a border of words; log probability)."""
    if c in _PLACE:
        steps = [(_PLACE[c], 0.0)]
    elif c == " ":
        steps = [(0, 0.0), (-1, 0.0)]
    elif c == "*" and masks <= MASKS:
        steps = [*((k, -MASK) for k in range(1, SYMBOLS)), (-1, -DROP)]
    else:
        steps = [*((_PLACE[x], -SWAP) for x in LEET.get(c, "")), (-1, -DROP if c in LEET else -APART)]
    return [*steps, (-1, -DRAWN)] if c == before and c != " " else steps


def decode(token: str, lm: np.ndarray) -> str:
    """The most probable letters behind a folded token: Viterbi over its lattice, states being the last two letters.

    A space may be a border of words or nothing. Time grows with the length. What all paths agree on is settled every MET
    characters; where they never agree, the best path so far is settled after SPAN characters, which bounds memory.
    """
    table, size = _table(lm), SYMBOLS
    # A state is the number of its last two letters.
    best: dict[int, float] = {0: 0.0}
    back: list[dict[int, tuple[int, int]]] = []
    out: list[str] = []
    before, masks = "", 0

    def settle(state: int) -> None:
        found = []
        for came in reversed(back):
            state, k = came[state]
            found.append("" if k < 0 else LETTERS[k - 1] if k else " ")
        out.extend(reversed(found))
        back.clear()

    for c in token:
        masks += c == "*"
        now: dict[int, float] = {}
        came: dict[int, tuple[int, int]] = {}
        steps = steps_of(c, before, masks)
        if len(steps) > SYMBOLS - 1 and len(best) > 9:
            now, came = _wide(best, lm, max(cost for k, cost in steps if k < 0))
        else:
            for state, score in best.items():
                tail = state % size * size
                for k, cost in steps:
                    if k < 0:
                        to, value = state, score + cost
                    else:
                        to, value = tail + k, score + cost + table[state * size + k]
                    if to not in now or value > now[to]:
                        now[to], came[to] = value, (state, k)
        best, before = now, c
        back.append(came)
        if len(back) >= MET and (len(best) == 1 or len(back) >= SPAN):
            last = max(best, key=lambda s: (best[s], s))
            settle(last)
            best = {last: best[last]}
    settle(max(best, key=lambda s: (best[s] + table[s * size], s)))
    return "".join(out)


def _wide(best: dict[int, float], lm: np.ndarray, none: float) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
    """A step of ``decode`` over a hidden letter from many states at once; ``none``: log probability of no letter."""
    score = np.full(SYMBOLS * SYMBOLS, -np.inf)
    score[list(best)] = list(best.values())
    ways = score.reshape(SYMBOLS, SYMBOLS, 1) + lm - MASK
    first, value = ways.argmax(0), ways.max(0)
    now = {s: v + none for s, v in best.items()}
    came = {s: (s, -1) for s in best}
    for b, k in np.argwhere(np.isfinite(value)).tolist():
        to = b * SYMBOLS + k
        if k and (to not in now or value[b, k] > now[to]):
            now[to], came[to] = float(value[b, k]), (int(first[b, k]) * SYMBOLS + b, k)
    return now, came


def folded(token: str) -> str:
    return token.lower() if token.isascii() else token.translate(FOLDS)


def restore(token: str, lm: np.ndarray) -> str:
    """The word behind a token as written; tokens that show no disguise are only folded and freed of edges."""
    word = trimmed(folded(token))
    if word.isalpha() and not THRICE.search(word):
        return word
    if not any(c in _PLACE for c in word):
        return word
    return decode(word, lm)


def spelled_out(rows: np.ndarray, at: np.ndarray, words: list[str]) -> list[tuple[int, int, int]]:
    """Runs of three and more single characters within a text: (row, first and end among the words of all texts)."""
    single = np.fromiter((len(w) == 1 or len(w) == 2 and not w[1].isalnum() for w in words), bool, len(words))[at]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= 3:
            cuts = [a, *(np.flatnonzero(np.diff(rows[a:b])) + a + 1).tolist(), b]
            out += [(int(rows[x]), x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x >= 3]
    return out


def respelled(letters: str, lm: np.ndarray) -> list[str]:
    """The words behind letters that were set apart; borders between them are found by the language model."""
    letters = "".join(c if (c := folded(x)) else "" for x in letters)
    return decode(" ".join(letters), lm).split() if any(c in _PLACE for c in letters) else [letters] if letters else []


def torn(rows: np.ndarray, at: np.ndarray, restored: list[str], lm: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of neighbouring words that are likelier one word, torn by spaces, than several: (row, first and end).

    Of two words, only the terms at the border differ: with the space dropped, two trigrams run over it.
    """
    ends = np.array([[_PLACE.get(w[0], 0), _PLACE.get(w[1], 0) if len(w) > 1 else -1, _PLACE.get(w[-2], 0) if len(w) > 1 else 0, _PLACE.get(w[-1], 0)] if w and w.isalpha() else [0, 0, 0, 0] for w in restored], np.int64).reshape(-1, 4)
    f1, f2, l1, l2 = ends[at].T
    a, b, c, d = l1[:-1], l2[:-1], f1[1:], f2[1:]
    # After a word of one letter stands a border.
    d = np.maximum(d, 0)
    gain = lm[a, b, c] + lm[b, c, d] - lm[a, b, 0] - lm[b, 0, c] - lm[0, c, d] - JOINED
    link = (gain > 0) & (b > 0) & (c > 0) & (rows[1:] == rows[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], link.astype(np.int8), [0]))))
    return [(int(rows[x]), x, y + 1) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % BUCKETS


def _tokens(batch: pa.RecordBatch, lm: np.ndarray, weights: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of restored words; with weights, only those that have one."""
    rows, at, words = words_of(batch.column("text"))
    codes = np.empty(len(words), np.int64)
    back = [restore(w, lm) for w in words]
    for k, word in enumerate(back):
        code = bucket(word)
        if weights is not None:
            if code not in weights and (double := TWICE.sub(r"\1", word)) != word and bucket(double) in weights:
                code = bucket(decode(word, lm))
            code = code if code in weights else -1
        codes[k] = code
    own = codes[at]
    more = []
    for r, a, b in spelled_out(rows, at, words):
        letters = "".join(words[k][0] for k in at[a:b].tolist())
        # A word of one letter may stand beside the run.
        for part in (letters, letters[1:], letters[:-1]) if weights is not None else (letters,):
            more += [(r, bucket(w)) for w in respelled(part, lm)]
    if weights:
        seen: dict[tuple[int, ...], int] = {}
        for r, a, b in torn(rows, at, back, lm):
            ks = tuple(at[a:b].tolist())
            for part in {ks, *itertools.pairwise(ks)}:
                if part not in seen:
                    seen[part] = bucket("".join(back[k] for k in part))
                more.append((r, seen[part]))
    more = [x for x in more if weights is None or x[1] in weights]
    keep = own >= 0
    pairs = np.concatenate((rows[keep] * BUCKETS + own[keep], np.array([r * BUCKETS + b for r, b in more], np.int64)))
    pairs = np.unique(pairs)
    return pairs // BUCKETS, pairs % BUCKETS


def _evidence(batch: pa.RecordBatch, lm: np.ndarray, weights: dict[int, float]) -> np.ndarray:
    rows, codes = _tokens(batch, lm, weights)
    # bincount of nothing gives integers
    return np.bincount(rows, np.fromiter((weights[c] for c in codes.tolist()), float, len(codes)), minlength=batch.num_rows).astype(float)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The language model, word evidence and logistic curve, learnt from ``docs`` and the labels that are not held out."""
    lm = language_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(lm)
    sample = labelled_sample(docs, labels, "toxic", rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            label = batch.column("label").to_numpy(zero_copy_only=False) > 0
            of, codes = _tokens(batch, shared.value)
            found, inverse = np.unique(codes, return_inverse=True)
            n1 = np.bincount(inverse, label[of], minlength=len(found))
            n = np.bincount(inverse, minlength=len(found))
            found, n1, n = np.append(found, BUCKETS), np.append(n1, label.sum()), np.append(n, len(label))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n1.astype(np.int64)), pa.array((n - n1).astype(np.int64))], ["code", "n1", "n0"])

    table = sample.mapInArrow(count, "code long, n1 long, n0 long").groupBy("code").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    total = table.where(F.col("code") == BUCKETS).first()
    if not total or not total["n1"] or not total["n0"]:
        return {"lm": lm, "weights": {}, "scale": 0.0, "base": -30.0 if not total or not total["n1"] else 30.0}
    big1, big0 = total["n1"], total["n0"]
    p1, p0 = (F.col("n1") + 0.5) / (big1 + 1), (F.col("n0") + 0.5) / (big0 + 1)
    p = (F.col("n1") + F.col("n0")) / (big1 + big0)
    z = F.abs(F.col("n1") - big1 * p) / F.sqrt(big1 * p * (1 - p) + 1e-9)
    strong = table.where((F.col("code") < BUCKETS) & (F.abs(F.log(p1 / p0)) >= float(np.log(LIFT))) & (z >= DEVIATIONS))
    weights = {r["code"]: r["w"] for r in strong.select("code", F.log(p1 / p0).alias("w")).collect()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_evidence(batch, shared.value, weights)), batch.column("label")], ["x", "label"])

    found = np.array(sample.mapInArrow(gather, "x double, label int").collect(), float).reshape(-1, 2)
    scale, base = logistic(found[:, 0], found[:, 1] > 0)
    return {"lm": lm, "weights": weights, "scale": scale, "base": base}


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge, in a fixed order of rows."""
    order = np.lexsort((y, x))
    a = np.stack((x[order], np.ones(len(x))), 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y[order] - p) - 1e-2 * w)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in text_slices(batches):
            logit = np.clip(m["scale"] * _evidence(batch, m["lm"], m["weights"]) + m["base"], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-logit)))], ["doc_id", "score"])

    out = narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def restored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and the text with every disguised token replaced by what it stands for (white space becomes single spaces)."""
    shared = docs.sparkSession.sparkContext.broadcast(model["lm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, at, words = words_of(batch.column("text"))
            back = [restore(w, shared.value) for w in words]
            said = [back[k] for k in at.tolist()]
            runs = [(a, b, "".join(said[a:b])) for _, a, b in torn(rows, at, back, shared.value)]
            runs += [(a, b, " ".join(respelled("".join(words[k][0] for k in at[a:b].tolist()), shared.value))) for _, a, b in spelled_out(rows, at, words)]
            for a, b, put in runs:
                said[a:b] = [put] + [""] * (b - a - 1)
            lists: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for r, word in zip(rows.tolist(), said, strict=True):
                if word:
                    lists[r].append(word)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(" ".join, lists), pa.string())], ["doc_id", "text"])

    return narrow(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; learns from ``docs`` and labels."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            values = [m["scale"] * _evidence(s, m["lm"], m["weights"]) + m["base"] for s in text_slices(iter([batch.select([at])]))]
            if values:
                yield batch.filter(pa.array(np.concatenate(values) < 0))

    return narrow(docs).mapInArrow(run, docs.schema)
