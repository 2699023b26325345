"""What SQL has no function for, in Arrow batches: compression, folding of letters, page text, fuzzy near-duplicates, clustering.

Each is one map-side pass over the rows it needs; only ``near_duplicates`` joins rows, on keys, and ``clusters`` reads
the rows of an owner in order, holding one text for each cluster.
"""

from __future__ import annotations

import difflib
import hashlib
import heapq
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from inkspan.plans.staging import settled

STOP = re.compile(r"(?<=[.!?])\s+")
CASUAL = re.compile(r"\b(honestly|look,|here'?s the thing|basically|you know|frankly|truth be told)\b", re.IGNORECASE)
#: Least likeness of near-duplicates, length band.
LIKENESS, BAND = 0.9, 0.05
#: Documents whose words are counted at once.
ROWS = 256
#: Keys that near-duplicates are looked for by; their hashes, word pairs hashed at once, hashes of words that are kept.
KEYS = 32
SEEDS = np.random.default_rng(2).integers(0, 2**63, 2 * KEYS).astype(np.uint64)
PAIRS, MOST_KNOWN = 4096, 500_000
#: Pairs of rows looked at at once; parts of texts whose product of lengths is so small are compared by difflib.
AT_A_TIME, SMALL = 4_000_000, 20_000
#: What is left out of an article, and of a page without one, by tag, role, class or part of a class.
IN_ARTICLE = frozenset({"script", "style", "nav", "aside"})
IN_PAGE = frozenset({"nav", "header", "footer", "aside", "script", "style", "noscript", "iframe"})
ROLES = frozenset({"navigation", "banner", "contentinfo"})
CLASSES, CLASS_PARTS = frozenset({"ad", "ads", "advertisement", "sidebar"}), ("cookie", "popup", "modal")
#: Tags that may be a page's main block; least characters of one; tags that never have an end.
BLOCKS, LEAST_BLOCK = frozenset({"div", "section", "article", "main"}), 200
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})


def _ratio(data: bytes, level: int) -> float:
    return len(zlib.compress(data, level)) / len(data)


def compression(text: str) -> float:
    """H6: score of a text's compressed share; texts under 200 characters have none."""
    if len(text) < 200:
        return 0.0
    r = _ratio(text.encode(), 9)
    return 40.0 if r < 0.35 else 20.0 if r < 0.45 else 0.0


def sentence_compression(sentence: str) -> float:
    """L1: the same for a sentence, and more if its windows compress alike."""
    if len(sentence) < 20:
        return 0.0
    data = sentence.encode()
    r = _ratio(data, -1)
    score = 60.0 if r < 0.35 else 40.0 if r < 0.45 else 20.0 if r < 0.55 else 0.0
    parts = [_ratio(data[k : k + 256], -1) for k in range(0, len(data) - 255, 128)]
    if len(parts) >= 2:
        m = sum(parts) / len(parts)
        score += 20 * (sum((p - m) ** 2 for p in parts) / len(parts) < 0.001)
    return score


def joint_compression(text: str) -> float:
    """L2: what compressing a text's sentences together saves."""
    sentences = [s for s in STOP.split(text.strip()) if s.strip()]
    if len(sentences) < 3:
        return 0.0
    sizes = [len(zlib.compress(s.encode())) for s in sentences]
    saved = (sum(sizes) - len(zlib.compress(text.encode()))) / sum(sizes)
    score = 60.0 if saved > 0.25 else 40.0 if saved > 0.18 else 20.0 if saved > 0.12 else 0.0
    ratios = [n / max(1, len(s.encode())) for n, s in zip(sizes, sentences, strict=True)]
    m = sum(ratios) / len(ratios)
    return score + 15 * (sum((r - m) ** 2 for r in ratios) / len(ratios) < 0.002)


def hollow_informality(text: str) -> float:
    """Casual markers, most of which nothing personal follows."""
    found = list(CASUAL.finditer(text))
    empty = sum(not re.search(r"\b(I|me|my|we|our)\b|\b[A-Z][a-z]{2,}\b", text[m.end() : m.end() + 150]) for m in found)
    return 25.0 if len(found) >= 2 and empty > len(found) / 2 else 0.0


def _scores(f):
    @pandas_udf(DoubleType())
    def apply(text: pd.Series) -> pd.Series:
        return text.fillna("").map(f).astype(float)

    return apply


compression_udf, sentence_compression_udf, joint_compression_udf, hollow_udf = map(_scores, (compression, sentence_compression, joint_compression, hollow_informality))


def _normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms folded, stripped, lower case, white space collapsed."""
    return text.map(lambda t: None if t is None else _normal(t))


class Node:
    """An element: tag, attributes, and what stands in it (texts and elements), with the length of its markup."""

    __slots__ = ("attrs", "inside", "parts", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.inside, self.parts = tag, attrs, 0, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        self.open[-1].parts.append(len(self.get_starttag_text() or ""))
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                self.open[-1].parts.append(len(tag) + 3)
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _left_out(node: Node, article: bool) -> bool:
    kind = node.attrs.get("class", "")
    if article:
        return node.tag in IN_ARTICLE or node.attrs.get("role") == "navigation"
    return node.tag in IN_PAGE or node.attrs.get("role") in ROLES or not CLASSES.isdisjoint(kind.split()) or any(c in kind for c in CLASS_PARTS)


def _walk(top: Node) -> list[Node]:
    """All elements below ``top``, in document order, without recursion."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed([x for x in node.parts if isinstance(x, Node)]))
    return out


def _read(top: Node, article: bool) -> tuple[str, dict[int, tuple[str, int]]]:
    """The text below ``top``, and each block's text and length of markup; what is left out counts in neither."""
    lines: list[str] = []
    blocks: dict[int, tuple[int, int, int]] = {}
    size, chars = 0, 0
    starts: dict[int, tuple[int, int]] = {}
    stack: list[tuple[Node | str | int, bool]] = [(top, False)]
    while stack:
        x, done = stack.pop()
        if isinstance(x, int):
            size += x
        elif isinstance(x, str):
            size += len(x)
            if t := " ".join(x.split()):
                lines.append(t)
        elif done:
            at, before = starts.pop(id(x))
            blocks[id(x)] = (at, len(lines), size - before)
        elif x is top or not _left_out(x, article):
            starts[id(x)] = len(lines), size
            stack.append((x, True))
            stack.extend((y, False) for y in reversed(x.parts))
    return "\n".join(lines), {k: ("\n".join(lines[a:b]), n) for k, (a, b, n) in blocks.items()}


def page_text(html: str) -> str:
    """The text of a page's first article, main part or part with that role; else of the block, over 200 characters long, that
    has the most text for its markup (length squared over markup; the first of equals); else of the whole body."""
    p = _Tree()
    p.feed(html)
    p.close()
    every = _walk(p.open[0])
    tests = (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main")
    for is_article in tests:
        for node in every:
            if is_article(node):
                return _read(node, True)[0]
    body = next((n for n in every if n.tag == "body"), p.open[0])
    whole, texts = _read(body, False)
    best, most = whole, 0.0
    for node in every:
        if node.tag in BLOCKS and id(node) in texts:
            text, markup = texts[id(node)]
            if len(text) > LEAST_BLOCK and len(text) ** 2 / max(1, markup) > most:
                best, most = text, len(text) ** 2 / max(1, markup)
    return best


@pandas_udf(StringType())
def page_text_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else page_text(h))


def _keys(norm: str, known: dict[str, int]) -> np.ndarray:
    """Keys that near-duplicates are looked for by, over all word pairs of a text: two minima of hashes make a key."""
    words = norm.split(" ")
    if len(known) > MOST_KNOWN:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    h = np.unique(_mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 2 else h)
    least = np.full(2 * KEYS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), PAIRS):
        np.minimum(least, _mixed(h[k : k + PAIRS] ^ SEEDS[:, None]).min(axis=1), out=least)
    return np.unique(_mixed(least[::2] * np.uint64(0xD6E8FEB86659FD93) + least[1::2] + np.arange(KEYS, dtype=np.uint64))).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for b in batches:
        norms = [*map(_normal, b["text"].to_pylist())]
        keys = [_keys(x, known) for x in norms]
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        digests = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in norms]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["scope"], pa.array([len(x) for x in norms], pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "scope", "size", "digest", "keys"])


def _partners(key: np.ndarray, ids: np.ndarray, sizes: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows sorted by key and size: the pairs (a later row, one before it of the same key and as long within BAND); ``first``: the smallest only."""
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    for lo, hi in zip(begins, np.r_[begins[1:], len(key)], strict=True):
        if hi - lo < 2:
            continue
        one, size = ids[lo:hi], sizes[lo:hi]
        left, right = np.searchsorted(size, np.ceil(size - BAND * size)), np.searchsorted(size, np.floor(size + BAND * size), "right")
        done = 0
        while done < hi - lo:
            ends = np.cumsum((right - left)[done:])
            n = max(1, int(np.searchsorted(ends, AT_A_TIME, "right")))
            count = (right - left)[done : done + n]
            a = np.repeat(np.arange(done, done + n), count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left[done : done + n], count)
            done += n
            keep = (one[b] < one[a]) & (np.abs(size[b] - size[a]) <= BAND * size[a])
            a, b = one[a[keep]], one[b[keep]]
            if first and len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                top = np.r_[True, a[1:] != a[:-1]]
                a, b = a[top], b[top]
            yield a, b


def _pairs(slim: DataFrame, first: bool) -> DataFrame:
    """Pairs of rows that share a key, key by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for one, two in _partners(*rows, first):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a_id", "doc_id"])

        for b in batches:
            held = [np.concatenate([x, b[c].to_numpy(False)]) for x, c in zip(held, ("key", "doc_id", "size"), strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from pairs([x[:last] for x in held])
            held = [x[last:] for x in held]  # the last key may go on in the next batch
        yield from pairs(held)

    rows = slim.repartition("key").sortWithinPartitions("key", "size").select("key", "doc_id", "size")
    return rows.mapInArrow(run, "a_id long, doc_id long").distinct()


def near_duplicates(docs: DataFrame, scope: str = "source") -> DataFrame:
    """doc_id and the smallest earlier doc_id of its scope that is as long within 5 % and alike, over the whole of both texts.

    Candidates share one of ``KEYS`` keys, each made of two minima of hashed word pairs of the whole text, so that texts with a
    few changed words anywhere meet; copies are collapsed first. Texts that are alike but share no key are missed: tests measure
    the share that is found. A text meets its smallest candidate first; only texts that aren't like theirs meet all others, so
    that a group of near copies costs one comparison for each of them. Texts move once for each pair that is compared.
    """
    n = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(scope).alias("scope"), "text")
    kind = n.schema["scope"].dataType.simpleString()
    sketches = n.mapInArrow(_sketches, f"doc_id long, scope {kind}, size long, digest binary, keys array<long>").where("scope is not null and size > 0")
    firsts = settled(sketches.groupBy("scope", "size", "digest").agg(F.min_by("keys", "doc_id").alias("keys"), F.min("doc_id").alias("doc_id")), "sketches")
    slim = firsts.select("doc_id", "size", F.explode("keys").alias("key"), "scope").select(F.xxhash64("scope", "key").alias("key"), "doc_id", "size")
    texts = n.select("doc_id", F.col("text").alias("shown"))

    def first_alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by a_id and doc_id: once a text's first like one is found, the others aren't compared."""
        last = None
        for b in batches:
            keep = []
            for a_id, x, y in zip(b["a_id"], b["a_shown"], b["shown"], strict=True):
                keep.append(a_id != last and _alike(_normal(x), _normal(y)))
                if keep[-1]:
                    last = a_id
            yield b.loc[keep, ["a_id", "doc_id"]]

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("doc_id").alias("a_id"), F.col("shown").alias("a_shown")), "a_id").join(texts, "doc_id")
        # a number, since partitions that are small in bytes would else be put together: their work goes with the square of texts
        parts = 8 * max(docs.sparkSession.sparkContext.defaultParallelism, 1)
        return both.repartition(parts, "a_id").sortWithinPartitions("a_id", "doc_id").select("a_id", "doc_id", "a_shown", "shown").mapInPandas(first_alike, "a_id long, doc_id long")

    nearest = settled(_pairs(slim, True).groupBy("a_id").agg(F.min("doc_id").alias("doc_id")), "nearest")
    found = settled(compared(nearest), "found")
    more = _pairs(slim, False).join(found.select("a_id"), "a_id", "left_anti").join(nearest, ["a_id", "doc_id"], "left_anti")
    return found.unionByName(compared(more)).select(F.col("a_id").alias("doc_id"), F.col("doc_id").alias("first_id"))


def _blocks(x: str, y: str) -> int:
    """Matched characters by difflib, over short texts."""
    return sum(m.size for m in difflib.SequenceMatcher(None, x, y, False).get_matching_blocks())


def _sums(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], np.cumsum(_mixed(x.astype(np.uint64) + np.uint64(1)) * powers[: len(x)])])


class _Longest:
    """Longest common runs of parts of two texts, the first of them in the one and then in the other, by hashes of runs."""

    def __init__(self, x: str, y: str):
        self.x, self.y = x, y
        n = max(len(x), len(y)) + 1
        self.powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
        self.one, self.two = (_sums(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), self.powers) for t in (x, y))

    def _hashes(self, sums: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
        """Of all runs of k characters, brought to the same power."""
        return (sums[lo + k : hi + 1] - sums[lo : hi + 1 - k]) * self.powers[len(self.powers) - 1 - np.arange(lo, hi + 1 - k)]

    def run(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int]:
        """Its beginnings and length, which is known to be ``most`` at most."""
        least, most = 0, min(ahi - alo, bhi - blo, most)
        at = 0, 0
        while least < most:
            k = (least + most + 1) // 2
            a, b = self._hashes(self.one, alo, ahi, k), self._hashes(self.two, blo, bhi, k)
            shared = np.isin(a, b)
            if shared.any():
                i = int(shared.argmax())
                least, at = k, (alo + i, blo + int((b == a[i]).argmax()))
            else:
                most = k - 1
        return *at, least


def _common_run_bound(x: str, y: str) -> int:
    """Length of the longest common subsequence, which no matching exceeds: bits of one row at a time."""
    at: dict[str, int] = {}
    for c in set(x):
        at[c] = 0
    for c in at:
        at[c] = int("".join("1" if o == c else "0" for o in reversed(x)), 2)
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def _alike(x: str, y: str) -> bool:
    """Whether the ratio (Ratcliff and Obershelp, over all characters) is at least LIKENESS; bounds from either side end it early."""
    total = len(x) + len(y)
    enough = lambda m: 2.0 * m / total >= LIKENESS
    if x == y or not total:
        return True
    if not enough(min(len(x), len(y))):
        return False
    one, two = (np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 4096, minlength=4096) for t in (x, y))
    if not enough(int(np.minimum(one, two).sum())):
        return False
    found, todo, hashed, bounded = 0, [(-min(len(x), len(y)), 0, len(x), 0, len(y), len(x))], None, False
    rest = min(len(x), len(y))
    while todo:
        if enough(found):
            return True
        if not enough(found + rest):
            return False
        size, alo, ahi, blo, bhi, most = heapq.heappop(todo)
        rest += size
        if (ahi - alo) * (bhi - blo) <= SMALL:
            found += _blocks(x[alo:ahi], y[blo:bhi])
            continue
        hashed = hashed or _Longest(x, y)
        i, j, k = hashed.run(alo, ahi, blo, bhi, most)
        if not k:
            continue
        if x[i : i + k] != y[j : j + k]:  # hashes that are equal by chance
            return difflib.SequenceMatcher(None, x, y, False).ratio() >= LIKENESS
        if not bounded and 16 * k < min(len(x), len(y)):
            bounded = True
            if not enough(_common_run_bound(x, y)):
                return False
        found += k
        for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
            if part[1] > part[0] and part[3] > part[2]:
                size = min(part[1] - part[0], part[3] - part[2])
                rest += size
                heapq.heappush(todo, (-size, *part, k))
    return enough(found)


def clusters(prompts: DataFrame) -> DataFrame:
    """Leader clustering of prompts (owner, seq, prompt, confidence) in order; clusters of five and more are significant.

    A prompt joins the cluster whose first prompt is most like it, if at all. The order of an owner's prompts decides, so
    an owner is read by one task, in order; what is held is one row for each of the owner's clusters, not its prompts.
    """
    columns = ["owner", "cluster", "frequency", "representative", "avg_confidence", "significant"]

    def done(owner: str, leaders: list[list]) -> pd.DataFrame:
        ranked = sorted(leaders, key=lambda c: -c[1])
        return pd.DataFrame([(owner, k, n, text, round(total / n, 3), n >= 5) for k, (_, n, text, total) in enumerate(ranked)], columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, leaders = None, []
        for b in batches:
            for who, text, confidence in zip(b["owner"], b["prompt"], b["confidence"], strict=True):
                if who != owner:
                    if leaders:
                        yield done(owner, leaders)
                    owner, leaders = who, []
                shown = " ".join(text.lower().split())[:200]
                best, most = None, 0.0
                m = difflib.SequenceMatcher()
                m.set_seq1(shown)
                for c in leaders:
                    m.set_seq2(c[0])
                    if (r := m.ratio()) > most:
                        best, most = c, r
                if best is not None and most >= 0.3:
                    best[1] += 1
                    best[2] = text if len(text) > len(best[2]) else best[2]
                    best[3] += confidence
                else:
                    leaders.append([shown, 1, text, confidence])
        if leaders:
            yield done(owner, leaders)

    rows = prompts.where("prompt is not null and prompt <> ''").select("owner", "seq", "prompt", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
    rows = rows.repartition("owner").sortWithinPartitions("owner", "seq")
    return rows.mapInPandas(run, "owner string, cluster int, frequency int, representative string, avg_confidence double, significant boolean")


# --- H42: how alike a document's sentences are ---
def _similarities(sentences: pa.ListArray) -> np.ndarray:
    """Mean pairwise cosine of each document's sentences (lists of words) under TF-IDF; nan without words or with one sentence."""
    per_doc = pc.fill_null(pc.list_value_length(sentences), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = sentences.flatten()
    doc_of = np.repeat(np.arange(len(per_doc)), per_doc)
    sent_of = np.repeat(np.arange(len(flat)), pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    words = flat.flatten().dictionary_encode()
    n = per_doc.astype(float)
    out = np.full(len(n), np.nan)
    if not len(words):
        return out
    kinds = len(words.dictionary)
    cell, tf = np.unique(sent_of * kinds + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    sent, word = cell // kinds, cell % kinds
    doc = doc_of[sent]
    _, term, df = np.unique(doc * kinds + word, return_inverse=True, return_counts=True)
    weight = tf * (np.log((n[doc] + 1) / (df[term] + 1)) + 1)
    square = np.bincount(sent, weight * weight, len(flat))
    total = np.bincount(term, weight / np.sqrt(square[sent]))
    first = np.zeros(len(total), np.int64)
    first[term] = doc
    some = np.bincount(doc_of[square > 0], minlength=len(n))
    several = (n > 1) & (some > 0)
    out[several] = (np.bincount(first, total * total, len(n))[several] - some[several]) / (n * (n - 1))[several]
    return out


def similarities(rows: DataFrame) -> DataFrame:
    """H42 of rows (doc_id, sentences): doc_id, n, sim. Rows stand alone: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), ROWS):
                part = b.slice(k, ROWS)
                sentences = part.column("sentences")
                sim = _similarities(sentences)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.fill_null(pc.list_value_length(sentences), 0).cast(pa.int64()), pa.array(sim, mask=np.isnan(sim))], ["doc_id", "n", "sim"])

    return rows.select("doc_id", "sentences").mapInArrow(run, "doc_id long, n long, sim double")


# --- P3: how much of an original's wording a rewrite keeps ---
TOKEN, GRAM = 70, 80
#: Runs of either side that are compared at once, and pairs of them.
SIDE, AT_ONCE = 2048, 50_000
_WORDS = re.compile(r"\b\w+\b")


def likeness(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths; the subsequence by bits of a whole number."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b)) if a or b else 100.0


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every character's number, text and place in it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return chars, np.repeat(np.arange(len(texts)), sizes), np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters (folded into 64 places) and lengths."""
    chars, rows, _ = _codes(texts)
    return np.bincount(rows * 64 + (chars & 63), minlength=64 * len(texts)).reshape(-1, 64), np.fromiter(map(len, texts), np.int64, len(texts))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the lesser counts of every two bags: counts are written as so many ones, and multiplied."""
    most = np.minimum(a.max(0, initial=0), b.max(0, initial=0))
    place = np.repeat(np.arange(64), most)
    level = np.arange(len(place)) - np.repeat(np.cumsum(most) - most, most)
    return (a[:, place] > level).astype(np.float32) @ (b[:, place] > level).astype(np.float32).T


def likenesses(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``likeness`` of pairs of texts, by their numbers; all pairs go through a text's characters together, 64 bits to a pair."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    swap = sizes[one] > sizes[two]
    short, long = np.where(swap, two, one), np.where(swap, one, two)
    out = np.zeros(len(one))
    wide = sizes[short] > 64
    out[wide] = [likeness(texts[i], texts[j]) for i, j in zip(one[wide].tolist(), two[wide].tolist(), strict=True)]
    at = np.flatnonzero(~wide)
    at = at[np.argsort(-sizes[long[at]], kind="stable")]
    chars, rows, places = _codes(texts)
    known, chars = np.unique(chars, return_inverse=True)
    where = np.zeros((len(texts), len(known)), np.uint64)
    fits = places < 64
    np.bitwise_or.at(where, (rows[fits], chars[fits]), np.uint64(1) << places[fits].astype(np.uint64))
    starts, short, long = np.cumsum(sizes) - sizes, short[at], long[at]
    v = np.full(len(at), ~np.uint64(0))
    ends = np.searchsorted(-sizes[long], -np.arange(sizes[long].max(initial=0)), side="left").tolist()
    for k, n in enumerate(ends):  # the first n texts have a character k
        w = v[:n]
        u = w & where[short[:n], chars[starts[long[:n]] + k]]
        v[:n] = w + u | w - u
    size = sizes[short]
    mask = np.where(size > 63, ~np.uint64(0), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
    total = sizes[short] + sizes[long]
    out[at] = np.where(total > 0, 200.0 * (size - np.bitwise_count(v & mask)) / np.maximum(total, 1), 100.0)
    return out


def _kept(mine: Counter, theirs: list[str], least: float, more: bool) -> int:
    """How many of ``mine`` (with their counts) are like one of ``theirs``; common characters bound the likeness from above."""
    known = set(theirs)
    kept = sum(n for x, n in mine.items() if x in known)
    rest = [x for x in mine if x not in known]
    above = np.greater if more else np.greater_equal
    for start in range(0, len(theirs), SIDE):
        block = theirs[start : start + SIDE]
        bags, sizes = _bags(block)
        left = []
        for k in range(0, len(rest), SIDE):
            part = rest[k : k + SIDE]
            own, size = _bags(part)
            one, two = np.nonzero(above(200.0 * _common(own, bags).astype(float) / (size[:, None] + sizes), least))
            hit = np.zeros(len(part), bool)
            for m in range(0, len(one), AT_ONCE):
                i, j = one[m : m + AT_ONCE], two[m : m + AT_ONCE]
                i, j = i[~hit[i]], j[~hit[i]]
                used, both = np.unique(np.concatenate((i, j + len(part))), return_inverse=True)
                names = [part[x] if x < len(part) else block[x - len(part)] for x in used.tolist()]
                hit[i[above(likenesses(names, both[: len(i)], both[len(i) :]), least)]] = True
            kept += sum(mine[x] for x, h in zip(part, hit.tolist(), strict=True) if h)
            left += [x for x, h in zip(part, hit.tolist(), strict=True) if not h]
        rest = left
    return kept


def overlap_of(original: str, rewrite: str) -> tuple[float, str]:
    """Share of the rewrite's runs of two to six words that the original has (nearly), blended with that of its words."""
    a, b = _WORDS.findall(original.lower()), _WORDS.findall(rewrite.lower())
    if not a or not b:
        return 0.0, "low"
    runs = lambda w: [" ".join(w[k : k + n]) for n in range(2, 7) for k in range(len(w) - n + 1)]
    mine = Counter(runs(b))
    grams = _kept(mine, list(dict.fromkeys(runs(a))), GRAM, True) / mine.total() if mine else 0.0
    words = _kept(Counter(b), list(dict.fromkeys(a)), TOKEN, False) / len(b)
    share = 0.3 * grams + 0.7 * words
    return round(share, 4), "high" if share > 0.7 else "moderate" if share > 0.4 else "low"


def ngram_overlap(pairs: DataFrame) -> DataFrame:
    """P3 for every row of (id, original, rewrite): overlap and label; null counts as empty. Rows stand alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [overlap_of(x or "", y or "") for x, y in zip(b["original"], b["rewrite"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "overlap": [x for x, _ in found], "label": [y for _, y in found]})

    return pairs.select("id", "original", "rewrite").mapInPandas(run, "id string, overlap double, label string")


# --- T12, N5, N6: chunks as the classifier sees them, and what is made of its answers ---
CHUNK_WORDS = 300
#: Weight of each of the classifier's buckets.
BUCKETS = {"human": 0.0, "light-ai": 0.33, "significant-ai": 0.67, "heavy-ai": 1.0}


def model_chunks(text: str) -> list[str]:
    """Chunks of at least 300 words that end with a sentence; what is left is a chunk of its own."""
    words = text.split()
    if len(words) <= CHUNK_WORDS:
        return [text]
    out, start = [], 0
    for k, w in enumerate(words):
        if k + 1 - start >= CHUNK_WORDS and w.endswith((".", "!", "?")):
            out.append(" ".join(words[start : k + 1]))
            start = k + 1
    return out + ([" ".join(words[start:])] if start < len(words) else [])


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, place, chunk; null texts have none."""

    @pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(model_chunks)

    return docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(cut("text")).alias("place", "chunk"))


def classified(answers: DataFrame) -> DataFrame:
    """From a model's logits for each chunk (doc_id, place, logits of the four buckets): probability of each document,
    its label, the mean of each bucket and the commonest bucket (of equally common ones the first)."""
    names = list(BUCKETS)
    shifted = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    rows = answers.withColumn("e", shifted).withColumn("p", F.transform("e", lambda x: x / total))
    ai = sum((F.col("p")[k] * w for k, w in enumerate(BUCKETS.values())), F.lit(0.0))
    rows = rows.select("doc_id", ai.alias("ai"), *(F.col("p")[k].alias(f"p{k}") for k in range(4)), (F.array_position("p", F.array_max("p")) - 1).alias("top"))
    found = rows.groupBy("doc_id").agg(F.avg("ai").alias("ai"), *(F.round(F.avg(f"p{k}"), 4).alias(names[k].replace("-", "_")) for k in range(4)), *(F.sum((F.col("top") == k).cast("int")).alias(f"n{k}") for k in range(4)))
    most = F.greatest(*(F.col(f"n{k}") for k in range(4)))
    modal = F.coalesce(*(F.when(F.col(f"n{k}") == most, F.lit(names[k])) for k in range(4)))
    label = F.when(F.col("ai") >= 0.7, "ai").when(F.col("ai") >= 0.4, "mixed").otherwise("human")
    return found.select("doc_id", F.round("ai", 4).alias("ai_probability"), label.alias("label"), modal.alias("modal_bucket"), *(n.replace("-", "_") for n in names))
