"""Operators of the llm folder against brute force, exact round trips and held-out accuracy, on small fixtures."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkspan.llm import components, curriculum, embedding_join, licenses, ngram_join, packing, pieces, quality, toxicity, transport, url_filter
from inkspan.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, size long"


def docs_of(spark, texts, sources=None):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, None, sources[k] if sources else "s", None, 7, 0.5, 3) for k, (i, t) in enumerate(texts)], DOC)


ODD = [(0, None), (1, ""), (2, " \t\n "), (3, "word"), (4, "word"), (5, "a b c d"), (6, "A B C D"), (7, "x " * 30_000), (None, "a b c d e f"), (8, "a b c d e f"), (8, "a b c d e f"), (9, "é ü \U0001f600 ▁  ")]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def family_texts(seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts, n = {}, 0
    for size in (40, 60, 90, 200):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(9):
            own = base[:]
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = r.choice(words)
            texts[n] = " ".join(own[: r.randrange(int(0.85 * size), size + 1)])
            n += 1
    for _ in range(6):
        texts[n] = " ".join(r.choice(words) for _ in range(80))
        n += 1
    return texts


@pytest.mark.parametrize("strip", [2048, 5])
def test_ngram_join_is_exact(spark, monkeypatch, strip):
    monkeypatch.setattr(ngram_join, "STRIP_SETS", strip)
    texts = family_texts()
    sets = {i: shingles(t) for i, t in texts.items()}
    want = brute_components(list(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    found = {r["doc_id"]: r for r in ngram_join.classes(docs_of(spark, list(texts.items()))).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(texts)


def test_ngram_join_odd_rows(spark):
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in ngram_join.classes(docs_of(spark, ODD)).collect())
    assert found == [(-1, 2, None), (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 2, 8), (8, 2, 8), (9, 1, 9)]
    kept = ngram_join.keep_one(docs_of(spark, ODD))
    assert kept.columns == docs_of(spark, ODD).columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 0, 1, 2, 3, 5, 7, 8, 8, 9]
    assert ngram_join.classes(docs_of(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)}


@pytest.mark.parametrize("strip", [4096, 16])
def test_embedding_join_is_exact(spark, monkeypatch, strip):
    monkeypatch.setattr(embedding_join, "STRIP", strip)
    monkeypatch.setattr(embedding_join, "LEAF", 8)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    x = np.concatenate([c + 0.25 * r.normal(size=(9, 8)) for c in centres]).astype(np.float32)
    x[5] = x[4]
    x[9] = 2 * x[8]
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = y @ y.T >= 0.9
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    odd = [(200, None, 0), (201, [0.0] * 8, 0), (202, [1.0, None] * 4, 0), (203, [math.inf] * 8, 0), (204, [1.0] * 7, 0), (None, rows[0][1], 0)]
    found = {r["vec_id"]: r for r in embedding_join.classes(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")).collect()}
    want = brute_components(range(len(x)), lambda a, b: hit[a, b])
    assert {i: found[i]["component_id"] for i in want} == want
    assert {i: found[i]["n_links"] for i in want} == {i: int(hit[i].sum()) - 1 for i in want}
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] and found[i]["component_id"] == i for i in range(200, 205))
    assert found[None]["component_id"] is None and not found[None]["kept"]
    assert embedding_join.classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize(("strip", "kind"), [(8192, "float"), (8, "double")])
def test_embedding_join_of_several_lengths_and_repeated_ids(spark, monkeypatch, strip, kind):
    monkeypatch.setattr(embedding_join, "STRIP", strip)
    r = np.random.default_rng(9)
    rows, k = [], 0
    for size, n in ((2, 30), (3, 12), (5, 4), (16, 40)):
        base = r.normal(size=(max(1, n // 5), size))
        for j in range(n):
            rows.append((k % 70, [float(v) for v in np.float32(base[j % len(base)] + 0.1 * r.normal(size=size))]))
            k += 1
    rows += [(900, [1.0, 0.0]), (901, [0.9, math.sqrt(1 - 0.81)]), (902, [1.0, 0.0, 0.0])]
    kept = [np.array(v, np.float32 if kind == "float" else float).astype(float) for _, v in rows]
    hit = lambda a, b: len(kept[a]) == len(kept[b]) and kept[a] @ kept[b] / (np.sqrt((kept[a] ** 2).sum()) * np.sqrt((kept[b] ** 2).sum())) >= 0.9
    want = []
    root = brute_components(range(len(rows)), hit)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root[n]] = min(i, least.get(root[n], i))
    for n, (i, _) in enumerate(rows):
        want.append((i, sum(hit(n, m) for m in range(len(rows)) if m != n), least[root[n]]))
    found = embedding_join.classes(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in found) == sorted(want)


def test_curriculum_against_plain_python(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)) or None) for i in range(300)]
    sources = [r.choice(["a", "b", "c", "d", None]) if i % 3 else "a" for i in range(300)]
    found = curriculum.curriculum(docs_of(spark, rows, sources)).collect()
    assert len(found) == 300 and [x["position"] for x in found if x["position"] is not None] == sorted(x["position"] for x in found if x["position"] is not None)
    size = Counter()
    for (_, t), s in zip(rows, sources, strict=True):
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        for s in full or set(open_):
            target[s] = 2 * size[s] if full else weight[s] * level
            left -= target[s]
        open_ -= full or set(open_)
    taken = Counter()
    for x in found:
        s = sources[x["doc_id"]]
        taken[s] += x["taken"]
        assert x["target"] == pytest.approx(target[s]) and x["source_size"] == size[s] and 0 <= x["taken"] <= 2 * x["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    mix = curriculum.mixed(docs_of(spark, rows, sources))
    assert mix.columns == docs_of(spark, []).columns and max(Counter(x["doc_id"] for x in mix.collect()).values()) == 2
    assert curriculum.curriculum(docs_of(spark, [])).count() == 0
    assert curriculum.curriculum(docs_of(spark, ODD)).count() == len(ODD)


def test_url_rules_and_reputation(spark):
    urls = ["http://A.Example.org/es/x", "https://example.org/en/12?q", "https://example.org/en/2", "http://b.com/fr/", "http://b.com/de/1", "http://b.com", "nothing", None, "http://bad.net/x", "http://new.bad.net/", "http://org/x", "http://xorg/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    seen = spark.createDataFrame([("http://bad.net/1", 0)] * 40 + [(f"http://good{k}.net/", 1) for k in range(40)] + [("http://bad.net/2", None)], "url string, good int")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, seen).collect()}
    assert found[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[1][2:] == ("example.org/en/1", "block") and found[2][2:] == ("org/", "allow")
    assert found[3][2:] == ("com/fr/", "allow") and found[4][2:] == ("com/de/", "block") and found[5] == ("b.com", "", None, "allow")
    assert found[6] == ("", "", None, "allow") == found[7]
    assert found[8][2:] == (None, "block") == found[9][2:] and found[10][2:] == ("org/", "allow") and found[11][2] is None
    empty = url_filter.judge(pages.limit(0), seen.limit(0))
    assert empty.count() == 0 and url_filter.judge(pages, seen.limit(0)).where("verdict = 'block'").count() == 3


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 9216, 9217, 100_000, 700_000])
def test_transport_round_trip(size):
    payload = transport.pad(random.Random(size).randbytes(size))
    media = transport.mux(payload)
    s = transport.demux(media)
    assert len(payload) % 576 == 0 and payload and s.payload == payload and not s.errors
    assert s.random_access == list(range(len(s.timestamps))) and s.timestamps == [transport.TICKS * k for k in range(len(s.timestamps))]
    if s.packets > 8:
        lost = bytearray(media)
        lost[4 * 188 + 3] ^= 5
        assert transport.Stream(bytes(lost)).errors


def test_transport_rows(spark):
    one = {r["doc_id"]: r for r in transport.media_digests(docs_of(spark, ODD[:8])).collect()}
    two = {r["doc_id"]: r for r in transport.from_media(transport.to_media(docs_of(spark, ODD[:8]))).collect()}
    assert one == two and one[0]["n_bytes"] == 0 and one[0]["payload_bytes"] == 576 and one[3][1:] == one[4][1:]


def test_packing_is_lossless(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3000)
    r = random.Random(2)
    texts = {i: "".join(r.choice("abc é") for _ in range(r.randrange(0, 300))) for i in range(60)}
    back = {}
    for row in packing.packed(docs_of(spark, list(texts.items())), row=64).collect():
        ids, positions, ends = np.frombuffer(row["ids"], "<u2"), np.frombuffer(row["positions"], "<u2"), row["lengths"]
        assert len(ids) == 64 and ends[-1] == row["n_tokens"] and (ids[ends[-1] :] == packing.PAD).all()
        for a, b, doc, part in zip(ends[:-1], ends[1:], row["doc_ids"], row["parts"], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            back[doc, part] = ids[a:b].tolist()
    for i, t in texts.items():
        ids = [x for k in sorted(k for d, k in back if d == i) for x in back[i, k]]
        assert ids[-1] == packing.END and bytes(ids[:-1]).decode() == t
    assert packing.digests(docs_of(spark, ODD)).agg({"n_segments": "sum"}).first()[0] >= len(ODD)
    assert packing.digests(docs_of(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_row():
    r = random.Random(4)
    for _ in range(50):
        sizes = sorted((r.randrange(1, 65) for _ in range(80)), reverse=True)
        rooms, want = [], []
        for k, s in enumerate(sizes):
            fit = [b for b, room in enumerate(rooms) if room >= s]
            if not fit:
                rooms.append(64)
                want.append([])
                fit = [len(rooms) - 1]
            least = min(rooms[b] for b in fit)
            rooms[fit[0] if rooms[fit[0]] == least else next(b for b in fit if rooms[b] == least)] -= s
        found = packing.best_fit(sizes, 64)
        assert sorted(k for b in found for k in b) == list(range(80)) and all(sum(sizes[k] for k in b) <= 64 for b in found)
        assert sorted(64 - sum(sizes[k] for k in b) for b in found) == sorted(rooms)


MODEL = pieces.Model.load(f"{Q.TOKENIZERS}/piece_bpe_32k.model")


def all_paths(unit):
    edges, out = [[], *(MODEL.ending(unit, j) for j in range(1, len(unit) + 1))], []

    def walk(j, score, ids):
        if not j:
            out.append((score, ids))
        for i, s, e in edges[j]:
            walk(i, score + s, e + ids)

    walk(len(unit), 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_n_best_against_all_paths():
    r = random.Random(6)
    for _ in range(200):
        unit = "".join(r.choice("▁theaning,日") for _ in range(r.randrange(1, 9)))
        want = all_paths(unit)
        found = MODEL.n_best(unit, 5)
        assert [s for s, _ in found] == pytest.approx([s for s, _ in want[:5]])
        best, ids, gap = MODEL.viterbi(unit)
        assert best == pytest.approx(want[0][0]) and (math.isinf(gap) if len(want) == 1 else gap == pytest.approx(want[0][0] - want[1][0]))


def test_n_best_of_a_text_equals_that_of_its_lattice(spark):
    for text in ("the cat, sat.", "on it", "a  b", ""):
        (best, several, units), *_ = pieces.Encoder(MODEL, 4).encode([text])
        whole = all_paths(pieces.MARK + text.replace(" ", pieces.MARK))[:4] if text else [(0.0, ())]
        assert [s for s, _ in several] == pytest.approx([s for s, _ in whole])
    found = pieces.encode(docs_of(spark, ODD[:7] + ODD[9:]), MODEL)
    texts = sorted((t or "") for _, t in ODD[:7] + ODD[9:])
    assert sorted(r["text"] for r in pieces.decode(found, MODEL).collect()) == texts
    assert all(r["round_trip"] for r in pieces.digests(docs_of(spark, ODD), MODEL).collect())


def labelled(spark, bad, good, n=400, seed=8):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = r.random() < 0.3
        words = [r.choice(["river", "stone", "cloud", "paper", "window", "garden", "market", "letter"]) for _ in range(30)]
        rows.append((i, bad(words, r) if y else good(words, r)))
        labels.append((i, int(y), int(not y)))
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_reads_disguises(spark):
    ways = ["moron", "m0ron", "mooooron", "m o r o n", "MORON!!", "m.o.r.o.n"]

    def bad(words, r):
        words[5] = r.choice(["moron", "moron", r.choice(ways)])
        return " ".join(words)

    docs, labels = labelled(spark, bad, lambda w, r: " ".join(w))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["predicted"] == r["toxic"] for r in found if r["held_out"]]) >= 0.98
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and 0 <= clean.count() - labels.where("toxic = 0").count() <= 6
    model = toxicity.fit(docs_of(spark, ODD), labels.limit(0))
    assert [r["score"] < 0.01 for r in toxicity.score(docs_of(spark, ODD), model).collect()] == [True] * len(ODD)


def test_viterbi_decoding():
    lm = toxicity.model_of(toxicity.trigram_counts(pa.array(["idiot stupid moron loser trash scum clown pathetic worthless disgusting "] * 50)).astype(float))
    for written in ("1d10t", "idi0t", "stuuuupid", "m0r0n", "tr@sh", "$cum", "cl*wn", "p4thet1c", "d-i-s-g-u-s-t-i-n-g", "ídiot", "IDIOT!!", "l0ser,"):
        assert toxicity.restore(written, lm) in "idiot stupid moron trash scum clown pathetic disgusting loser".split(), written


def test_quality_learns_junk(spark):
    docs, labels = labelled(spark, lambda w, r: " ".join(x + "***" for x in w), lambda w, r: " ".join(w) + ".")
    labels = labels.withColumn("quality", labels["quality"])
    found = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found if r["held_out"]]) >= 0.98
    assert quality.keep_good(docs, labels).columns == docs.columns
    odd = docs_of(spark, ODD)
    assert quality.score(odd, quality.fit(odd, labels.limit(0))).where("predicted = 1").count() == len(ODD)


def test_licences(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing"), ("a/b/y.txt", "one\nLicensed under the Apache License, Version 2.0.\nlicense"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z", ""), ("z/y", None), (None, "Licensed under CC BY-NC 4.0."), ("top", "text")]
    found = {r["path"]: (r["licence"], r["origin"]) for r in licenses.scan(spark.createDataFrame([(p, t, 1.0) for p, t in files], "path string, text string, cosine double")).collect()}
    assert found == {"a/LICENSE": ("MIT", "file"), "a/b/x.txt": ("MIT", "directory"), "a/b/y.txt": ("Apache-2.0", "file"), "a/b/c/COPYING": ("GPL-3.0", "file"), "a/b/c/d/z": ("GPL-3.0", "directory"), "z/y": (None, None), None: (None, None), "top": (None, None)}


def test_long_prose_with_a_few_words_of_a_licence_declares_none(spark):
    r = random.Random(3)
    prose = [f"{a}{b}{c}" for a in ("mor", "tel", "san", "vik") for b in ("a", "o", "ei", "u") for c in ("n", "rd", "lt", "mp")]
    text = " ".join([*r.choices(prose, k=300), "lost his license and you may not use this", *r.choices(prose, k=300), "except in trade with"])
    notice = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."
    within = " ".join([*r.choices(prose, k=300), notice, *r.choices(prose, k=300)])
    files = [("a/1", text), ("b/1", within), *((f"c/{k}", " ".join(r.choices(prose, k=60))) for k in range(20))]
    found = {r["path"]: r["licence"] for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect() if r["licence"]}
    assert found == {"b/1": "Apache-2.0"}


def test_a_heading_is_no_licence(spark):
    files = [("a/1", "# License\ntext"), ("b/1", "the license"), ("c/1", "Licensed"), ("d/1", "Released under the MIT License."), *((f"e/{k}", "plain words of the text") for k in range(40))]
    assert {r["path"] for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect() if r["licence"]} == {"d/1"}


def test_licence_cosine_is_that_of_tf_idf(spark):
    files = [("a", "Licensed under the the MIT license, said Tom"), ("b", "the cat"), ("c", "Released under the MIT License. Permission is hereby granted, free of charge, to anyone")]
    tokens = {p: re.findall("[a-z]+|[0-9]+", t.lower()) for p, t in files}
    idf = lambda w: math.log(4 / (1 + sum(w in ws for ws in tokens.values()))) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    said = "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy."
    t, own = vector(re.findall("[a-z]+", said.lower())), vector(tokens["c"])
    rows = licenses.declared(spark.createDataFrame(files, "path string, text string"), {"MIT": said}).collect()
    got = {r["path"]: r["cosine"] for r in rows}
    assert got["c"] == pytest.approx(sum(x * t.get(w, 0) for w, x in own.items()) / norm(t) / norm(own))
    assert "b" not in got


def test_wrapped_headers_and_untitled_licence_files(spark):
    wrap = lambda text, n: "\n".join(" * " + " ".join(ws) for ws in itertools.batched(text.split(), n))
    code = "\n".join(f"int f{k}(int x) {{ return x * {k}; }}" for k in range(60))
    files = [("m/LICENSE", wrap(licenses.TEXTS["MIT"][0], 9)), ("m/src/a.c", code)]
    files += [(f"{n}/a.c", wrap(licenses.TEXTS[n][0], 6) + "\n" + code) for n in ("Apache-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "BSD-3-Clause")]
    files += [(f"none/{k}", code) for k in range(10)]
    found = {r["path"]: (r["licence"], r["origin"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect() if r["licence"]}
    assert found == {"m/LICENSE": ("MIT", "file"), "m/src/a.c": ("MIT", "directory"), **{p: (p.split("/")[0], "file") for p, _ in files[2:7]}}


def test_pipeline_equals_its_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    first = pipeline.drop_toxic(spark, docs, SF)
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in docs.collect()} - toxic
    second = pipeline.drop_low_quality(spark, first, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in second.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    root = brute_components(sorted(texts), lambda a, b: bool(sets[a] or sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    third = pipeline.drop_near_duplicates(spark, second, SF).cache()
    assert {r["doc_id"] for r in third.collect()} == {i for i, c in root.items() if i == c}
    fourth = pipeline.mix_sources(spark, third, SF)
    final = pipeline.encode_pieces(spark, fourth, SF)
    mixed = Counter(r["doc_id"] for r in fourth.collect())
    found = pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in found) == mixed == Counter(r["doc_id"] for r in final.collect())
    assert all(MODEL.decode(r["ids"]) == texts[r["doc_id"]] for r in found)


def test_packing_with_a_public_vocabulary_is_lossless(spark):
    import tiktoken

    vocabulary = packing.ranked(f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken")
    back: dict = {}
    rows = [(i, t) for i, t in ODD if i not in (None, 8)]
    for r in packing.packed(docs_of(spark, rows), row=128, vocabulary=vocabulary).collect():
        ids, ends = np.frombuffer(r["ids"], "<u2"), r["lengths"]
        assert (ids[ends[-1] :] == vocabulary.pad).all()
        for a, b, doc, part in zip(ends[:-1], ends[1:], r["doc_ids"], r["parts"], strict=True):
            back[doc, part] = ids[a:b].tolist()
    import base64

    import public_tokenizers as public

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{Q.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in rows:
        ids = [x for k in sorted(k for d, k in back if d == i) for x in back[i, k]]
        assert ids[-1] == vocabulary.end and own.decode(ids[:-1]) == (t or "") and ids[:-1] == own.encode_ordinary(t or "")


def test_ids_are_checked_and_may_be_wide(spark):
    wide = packing.Vocabulary(lambda t: [70_000 + ord(c) for c in t], 1, 2, 32)
    docs = docs_of(spark, [(0, "abc"), (1, None)])
    rows = packing.packed(docs, row=16, vocabulary=wide).collect()
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4")[: r["n_tokens"]] for r in rows]).tolist()
    assert sorted(ids) == sorted([70_097, 70_098, 70_099, 1, 1]) and all(len(r["positions"]) == 64 for r in rows)
    assert packing.Vocabulary(lambda t: np.array([5, 6], np.int64)).ids("x").tolist() == [5, 6, packing.END]
    for wrong in ([65_536], [-1], [0.5], [[1]]):
        with pytest.raises(ValueError):
            packing.Vocabulary(lambda t, x=wrong: x).ids("x")


def paths_of(token, lm):
    """Every path of a token's lattice, the letters of the best ones."""
    before, masks, options = "", 0, []
    for c in token:
        masks += c == "*"
        options.append(toxicity.steps_of(c, before, masks))
        before = c
    found = []
    for path in itertools.product(*options):
        a = b = 0
        value, out = 0.0, ""
        for k, cost in path:
            value += cost
            if k >= 0:
                value += lm[a, b, k]
                a, b = b, k
                out += toxicity.LETTERS[k - 1] if k else " "
        found.append((value + lm[a, b, 0], out))
    most = max(found)[0]
    return {out for value, out in found if value >= most - 1e-9}


def test_viterbi_finds_the_best_of_all_paths():
    r = random.Random(12)
    words = ["idiot", "stupid", "moron", "loser", "trash", "scum", "clown", "the", "river", "of", "a"]
    lm = toxicity.model_of(toxicity.trigram_counts(pa.array([" ".join(r.choice(words) for _ in range(4000))])).astype(float))
    tokens = ["".join(r.choice("aestid10*.! ") for _ in range(r.randrange(1, 6))) for _ in range(120)]
    for token in [*tokens, "a s t u", "l 0 s e r", "t*a*h", "s**m"]:
        if token.count("*") <= 2:
            assert toxicity.decode(token, lm) in paths_of(token, lm), token


def test_spaces_put_into_words_are_found(spark):
    r = random.Random(3)
    plain = ["such", "man", "the", "river", "was", "very", "old", "and", "he", "a", "an", "in", "it"]
    lm = toxicity.model_of(toxicity.trigram_counts(pa.array([" ".join(r.choice([*plain, "stupid", "idiot", "scum"]) for _ in range(6000))])).astype(float))
    assert toxicity.respelled("astupid", lm) == ["a", "stupid"] and toxicity.respelled("idiotscum", lm) == ["idiot", "scum"]
    docs = docs_of(spark, [(0, "such a s t u p i d man"), (1, "i d i o t s c u m"), (2, "the stu pid river"), (3, "the old river")])
    assert {x["doc_id"]: x["text"] for x in toxicity.restored(docs, {"lm": lm}).collect()} == {0: "such a stupid man", 1: "idiot scum", 2: "the stupid river", 3: "the old river"}


@pytest.mark.parametrize("token", ["Chapter" + "." * 100_000 + "x", "a" + "*" * 100_000 + "b", "a1" * 50_000, "=" * 100_000 + "x", "-a" * 50_000, "a*" * 50_000, "#$" * 50_000, "a" * 100_000])
def test_long_tokens_take_linear_time(token):
    import time

    lm = toxicity.model_of(toxicity.trigram_counts(pa.array(["idiot stupid moron " * 50])).astype(float))
    began = time.process_time()
    toxicity.restore(token, lm)
    long = time.process_time() - began
    began = time.process_time()
    toxicity.restore(token[: len(token) // 10], lm)
    assert long < 5 and long < 40 * (time.process_time() - began) + 1


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(few)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (400, 400)]
    ids = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    want = brute_components(ids, lambda a, b: frozenset((a, b)) in linked)
    found = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {a: b for a, b in want.items() if a != b}


@pytest.mark.parametrize(("bits", "keys"), [(1 << 10, 7), (1 << 27, 500_000)])
def test_ngram_join_with_saturated_bits(spark, monkeypatch, bits, keys):
    """With few bits nearly all shingles count as shared: more work, the same classes."""
    monkeypatch.setattr(ngram_join, "SHARED_BITS", bits)
    monkeypatch.setattr(ngram_join, "_SHIFT", np.uint64(64 - bits.bit_length() + 1))
    monkeypatch.setattr(ngram_join, "KEYS", keys)
    texts = family_texts(31)
    sets = {i: shingles(t) for i, t in texts.items()}
    want = brute_components(list(texts), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert {x["doc_id"]: x["component_id"] for x in ngram_join.classes(docs_of(spark, list(texts.items()))).collect()} == want


def test_ngram_join_keeps_links_when_a_copy_has_no_id(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    found = {x["doc_id"]: x["component_id"] for x in ngram_join.classes(docs_of(spark, [(None, " ".join(base)), (4, " ".join(base)), (2, near)]).coalesce(1)).collect()}
    assert found == {None: None, 4: 2, 2: 2}


def test_n_best_of_long_units_and_ties():
    for unit in ("a" * 3000, "ab" * 2000, "=" * 3000):
        (best, several, units), *_ = pieces.Encoder(MODEL, 4).encode([unit])
        encoder = pieces.Encoder(MODEL, 4)
        every = [encoder.ids_of(units, swaps) for _, swaps in several]
        assert all(MODEL.decode(x) == unit for x in every) and len({tuple(x) for x in every}) == len(every)
        scores = [s for s, _ in several]
        assert scores == sorted(scores, reverse=True) and scores[0] == pytest.approx(sum(MODEL.logp[k] for k in best))
    for unit in ("▁aaaaaa", "aaaa", "thethe"):
        assert [s for s, _ in MODEL.n_best(unit, 6)] == pytest.approx([s for s, _ in all_paths(unit)[:6]])


def test_transport_stream_by_an_independent_walk():
    """Packets are walked by the published layout alone: sync bytes, PAT to PMT to the stream's PID, counters, payloads."""
    payload = transport.pad(random.Random(5).randbytes(40_000))
    media = transport.mux(payload)
    assert len(media) % 188 == 0
    tables, counters, pieces_of, program, stream = {}, {}, bytearray(), None, None
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        pid, start, control, counter = (p[1] & 0x1F) << 8 | p[2], p[1] >> 6 & 1, p[3] >> 4 & 3, p[3] & 15
        body = p[4:] if control == 1 else p[5 + p[4] :] if control == 3 else b""
        if pid == 0x1FFF:
            continue
        if control & 1:
            assert pid not in counters or counter == (counters[pid] + 1) & 15
            counters[pid] = counter
        if pid == 0 and start:
            s = body[1 + body[0] :]
            program = (s[10] & 0x1F) << 8 | s[11]
        elif pid == program and start:
            s = body[1 + body[0] :]
            info = (s[10] & 15) << 8 | s[11]
            stream = (s[13 + info] & 0x1F) << 8 | s[14 + info]
        elif pid == stream:
            if start:
                assert body[:3] == b"\0\0\1"
                body = body[9 + body[8] :]
            pieces_of += body
        tables[pid] = tables.get(pid, 0) + 1
    assert program is not None and stream is not None and bytes(pieces_of) == payload


def test_quality_vectors_pooling_and_temperature_against_plain_loops(spark):
    texts = ["the the cat, sat 12 Times", "", "A b c A b c !!!", "the cat"]
    places, signs = quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        _, codes = quality.sequence(pa.array([t]))
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if i != j and abs(i - j) <= quality.WINDOW:
                    for k in range(quality.NONZERO):
                        total[a, places[b, k]] += signs[b, k]
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    vectors = quality.word_vectors(docs_of(spark, list(enumerate(texts))))
    assert np.allclose(vectors, want, atol=1e-6)
    found = quality.pooled(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), vectors)
    for t, row in zip(texts, found, strict=True):
        _, codes = quality.sequence(pa.array([t]))
        mean = lambda x, codes=codes: np.mean([x[c] for c in codes], 0) if len(codes) else np.zeros(quality.DIM)
        assert np.allclose(row, np.concatenate((mean(vectors), mean(vectors * vectors))), atol=1e-5)
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 6))
    y = (x[:, 0] + 0.5 * r.normal(size=600) > 0).astype(float)
    net = quality.Network(x, y)
    logits = net.logits(x)
    loss = lambda s: np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits) / s))
    assert ((net.probability(x) >= 0.5) == (y > 0)).mean() > 0.8 and loss(net.temperature) <= loss(1.0) + 0.02


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_and_odd_rows_in_every_operator(spark, tmp_path):
    none, labels = spark.createDataFrame([], EMPTY), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0 and toxicity.keep_clean(none, labels).count() == 0
    assert quality.score(none, quality.fit(none, labels)).count() == 0 and quality.keep_good(none, labels).count() == 0
    assert transport.media_digests(none).count() == 0 and pieces.digests(none, MODEL).count() == 0 and pieces.encode_best(none, MODEL).count() == 0
    assert licenses.scan(none.selectExpr("source as path", "text")).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string, good int")).count() == 0
    odd = docs_of(spark, ODD)
    assert transport.media_digests(odd).count() == len(ODD) and pieces.encode_best(odd, MODEL).count() == len(ODD)
    urls = [(1, "http://a.net/x"), (1, "http://a.net/x"), (2, "http://" + "b" * 50_000 + ".org/" + "y" * 50_000), (None, None)]
    judged = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([("http://a.net/1", 1)], "url string, good int")).collect()
    assert len(judged) == 4 and all(x["verdict"] in ("allow", "block") for x in judged)
    same = [("a/LICENSE", "Released under the MIT License."), ("a/LICENSE", "Released under the MIT License."), ("a/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/x", "word " * 100_000)]
    once, again = ([tuple(x) for x in sorted(licenses.scan(spark.createDataFrame(same, "path string, text string")).collect(), key=str)] for _ in range(2))
    assert once == again and len(once) == 4


def test_pipeline_with_odd_rows_and_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = [(k, 1, int(k % 2)) for k in range(0, 10)] + [(None, None, None)]
    for name, rows in (("odd", ODD), ("none", [])):
        docs_of(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        found = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(x["doc_id"] is None or x["doc_id"] in range(10) for x in found) and (rows or not found)
