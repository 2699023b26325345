"""Results worked out by hand from the rules; the SQL runs in DuckDB here, test_operators compares both engines."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata

import duckdb
import pytest

from inkspan.functions import dialect, guidance
from inkspan.functions import lexicons as L
from inkspan.functions.dialect import Duck
from inkspan.operators import corpus, document, guide, profile, sentence, udfs, vectors
from inkspan.sources import readers

FILL = " ".join(["apple"] * 200)


def run(sql: str, docs: list[tuple], **tables: str) -> list[tuple]:
    """A statement over documents (doc_id, text, source, lang) and further tables given as SQL."""
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar, lang varchar)")
    if docs:
        c.executemany("insert into documents values (?, ?, ?, ?)", [(*d, *("s", "en")[len(d) - 2 :])[:4] for d in docs])
    for name, body in tables.items():
        c.execute(f"create table {name} as {body}")
    for name in ("documents", *tables):
        sql = sql.replace(f"{{{name}}}", name)
    return c.execute(sql).fetchall()


def test_intensifiers_and_transitions():
    text = f"Very good, quite rather {FILL}. However it thus rests. Instead we go. Finally done indeed."
    found = {r[1]: r for r in run(profile.element_query(Duck()), [(1, text)])}
    words = 3 + 1 + 200 + 4 + 3 + 3
    assert found["intensifier_rate"][5] == pytest.approx(min(1, 3 / words / 0.02), abs=1e-4) and found["intensifier_rate"][4] == "more"
    assert found["transition_word_rate"][5] == pytest.approx(min(1, 3 / 4 / 0.2), abs=1e-4)


def test_rewriting_by_rules():
    text = "We utilize robust tools. It is worth noting that cats sleep!  In conclusion, this works. Streamlined is kept."
    want = "We use strong tools. cats sleep! this works. Streamlined is kept."
    assert run(corpus.r01(Duck()), [(1, text), (2, None)]) == [(1, hashlib.sha256(want.encode()).hexdigest(), 3)]


def test_compliance():
    sql = corpus.v02(Duck())
    names = ["doc_id", "banned_words", *corpus.STRUCTURAL, "violations", "compliant"]
    rows = [dict(zip(names, r, strict=True)) for r in run(sql, [(1, "A state-of-the-art paradigm; furthermore, it is easy to see."), (2, "In conclusion we rest. Not only cats but also dogs."), (3, "Plain words.")])]
    assert rows[0] | {"doc_id": 1} == {"doc_id": 1, "banned_words": 2, "impersonal_construction": 1, "ai_conclusion": 0, "ai_transition": 1, "parallel_construction": 0, "violations": 4, "compliant": False}
    assert (rows[1]["ai_conclusion"], rows[1]["parallel_construction"], rows[1]["violations"]) == (1, 1, 2) and rows[2]["compliant"]
    assert len(corpus.BANNED) == 27


@pytest.mark.parametrize(
    ("kind", "direction", "weight", "value", "element", "want"),
    [
        ("metric", None, 0.71, 15.04, "avg_sentence_length", "Target closely a average sentence length of 15.0."),
        ("metric", None, 0.7, 8.26, "smog_index", "Target approximately a SMOG index of 8.3."),
        ("metric", None, 0.4, 8.0, "smog_index", "Target roughly a SMOG index of 8.0."),
        ("directional", "more", 0.19, None, "em_dash_usage", "Use em dashes occasionally."),
        ("directional", "more", 0.2, None, "colon_usage", "Use colons sometimes."),
        ("directional", "more", 1.0, None, "rare_word_rate", "Use rare word rate consistently."),
        ("directional", "less", 0.0, None, "comma_rate", "Slightly reduce commas per sentence."),
        ("directional", "less", 0.6, None, "ellipsis_usage", "Strongly avoid ellipses."),
        ("directional", "less", 0.8, None, "ellipsis_usage", "Never use ellipses."),
    ],
)
def test_weights_in_words(kind, direction, weight, value, element, want):
    lit = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    row = f"select {lit(element)} as element, {lit(kind)} as kind, {lit(direction)} as direction, {weight} as weight, cast({lit(value)} as double) as value"
    assert duckdb.sql(f"select {guide.instruction(Duck())} from ({row}) x").fetchall() == [(want,)]


@pytest.mark.parametrize(
    ("element", "weight", "want"),
    [
        ("ellipsis_usage", 0.5, "4-5"), ("ellipsis_usage", 0.0, "1-2"), ("exclamation_rate", 0.1, "3"), ("first_person_usage", 0.2, "~12"), ("quotation_density", 0.4, "3-4 quotes"), ("single_sentence_paragraph_ratio", 0.5, "~4"),
        ("narrative_vs_analytical_ratio", 0.3, "~70"), ("passive_voice_rate", 0.125, "~12"), ("article_rate", 0.0625, "~6.2"), ("hedging_language_rate", 0.05, "~2"), ("parenthetical_usage", 0.15, "4"),
        ("semicolon_usage", 0.01, "1"), ("transition_word_rate", 0.5, "3"), ("topic_coherence_score", 0.5, "~0.5"), ("sentence_length_stddev", 0.9, ""), ("comma_rate", 0.33, "~33%"),
    ],
)
def test_counts_that_are_asked_for(element, weight, want):
    assert duckdb.sql(f"select {guide.count_of(Duck())} from (select '{element}' as element, cast({weight} as double) as weight) x").fetchall() == [(want,)]


def test_patterns_are_mapped_by_their_longest_prefix():
    docs = [(1, "In conclusion, we delve into the realm of cats. Furthermore, it rests."), (2, "Plain.")]
    found = {r[1] for r in run(guide.pattern_rules(Duck()), docs) if r[0] == 1}
    shown = {r[0] for r in run(guide.found_patterns(Duck()) + " select distinct pattern from z_found where doc_id = 1", docs)}
    want = {guidance.PATTERN_RULES[max((k for k in guidance.PATTERN_RULES if p.startswith(k)), key=len)] for p in shown if any(p.startswith(k) for k in guidance.PATTERN_RULES)}
    assert found == want and "buzzword" in shown and "ai_transition" in shown


def test_baselines_are_over_all_windows_of_a_genre():
    r = random.Random(1)
    texts = [" ".join(f"w{'abcdefghij'[r.randrange(10)]}{'xyz'[r.randrange(3)]}" for _ in range(n)) for n in (60, 130, 240, 20)]
    windows, chunks = [], []
    for t in texts:
        w = t.split()
        windows += [len(set(w[k : k + 50])) / 50 for k in range(len(w) - 49)]
        chunks += [len(set(w[k : k + 100])) / 100 for k in range(0, len(w) - 99, 100)]
    mean = lambda x: sum(x) / len(x)
    sd = lambda x: math.sqrt(sum((v - mean(x)) ** 2 for v in x) / len(x))
    [(lang, *found)] = run(corpus.l11(Duck()), [(k, t) for k, t in enumerate(texts)])
    assert lang == "en" and found == pytest.approx([mean(windows), sd(windows), mean(chunks), sd(chunks)], abs=2e-6)


def test_blank_and_null_texts_have_rows_that_score_nothing():
    docs = [(0, None), (1, ""), (2, " \n "), (3, "word")]
    for name, (_, steps) in document.SIGNALS.items():
        found = dict(run(document.statement(Duck(), steps(Duck()), {"score": "score"}, "{documents}"), docs))
        assert set(found) == {0, 1, 2, 3} and [found[k] for k in (0, 1, 2)] == [0, 0, 0], name
    for make in (corpus.l05, corpus.l06, corpus.h42, corpus.h43):
        assert {r[0]: r[-1] for r in run(make(Duck()), docs)} == {0: 0, 1: 0, 2: 0, 3: 0}
    whole = {r[0]: r for r in run(sentence.analysis(Duck()), docs)}
    assert set(whole) == {0, 1, 2, 3} and whole[0][4:] == (0, "general", 0, 0, 0, "clean", "high")


def test_consensus_and_discovered_patterns():
    docs = [(k, f"Word{k} {FILL} " + ("very " * 30 if k == 2 else "") + "ends.") for k in range(3)]
    found = {r[1]: r for r in run(guide.consensus(Duck()), docs)}
    assert found["intensifier_rate"][3] + found["intensifier_rate"][4] == 3 and found["intensifier_rate"][5]
    docs = [(1, "Overall, cats rest. Plain."), (2, "In essence, dogs rest."), (3, "We leverage it.")]
    places = {r[1]: (r[2], r[3], r[4]) for r in run(guide.discovered(Duck()), docs)}
    assert places["ai_transition"] == (2, 2, 1) and places["buzzword"][1] == 3
    assert ("ai_transition", 0) in [r[1:] for r in run(guide.synced(Duck()), docs)]


def test_overlap_of_rewrites():
    base = "the quick brown fox jumps over the lazy dog near the old river bank"
    assert udfs.overlap_of(base, base) == (1.0, "high")
    assert udfs.overlap_of(base, "") == (0.0, "low") == udfs.overlap_of("", base)
    assert udfs.overlap_of(base, "completely unrelated zzz qqq vvv kkk")[1] == "low"
    assert udfs.likeness("kitten", "sitting") == pytest.approx(200 * 4 / 13) and udfs.likeness("", "") == 100
    r = random.Random(4)
    words = ["quick", "quack", "brown", "browne", "fox", "over", "under", "river", "rivers", "bank"]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    ratio = lambda a, b: 200 * common(a, b) / (len(a) + len(b))
    for _ in range(15):
        a, b = ([r.choice(words) for _ in range(r.randrange(1, 12))] for _ in range(2))
        runs = lambda w: [" ".join(w[k : k + n]) for n in range(2, 7) for k in range(len(w) - n + 1)]
        grams = [g in runs(a) or any(ratio(g, o) > 80 for o in runs(a)) for g in runs(b)]
        tokens = [any(ratio(x, y) >= 70 for y in a) for x in b]
        want = 0.3 * (sum(grams) / len(grams) if grams else 0) + 0.7 * sum(tokens) / len(tokens)
        assert udfs.overlap_of(" ".join(a), " ".join(b))[0] == pytest.approx(want, abs=1e-4)


def udfs_normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def test_near_duplicates_find_texts_with_changed_words(spark):
    r = random.Random(7)
    texts = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len((x["text"] or "").split()) >= 60]
    rows, pairs = [], 0
    for k, text in enumerate(texts):
        base = udfs_normal(text).split()
        other = base[:]
        for at in (3, 11, r.randrange(16, 60)):
            other[at] = r.choice(base)
        a, b = " ".join(base), " ".join(other)
        pairs += a != b and udfs._alike(b[:500], a[:500]) and abs(len(a) - len(b)) <= 0.05 * len(b)
        rows += [(2 * k, a, str(k)), (2 * k + 1, b, str(k))]
    found = udfs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    hits = sum(x["doc_id"] == x["first_id"] + 1 and x["doc_id"] % 2 == 1 for x in found)
    assert pairs >= 50 and hits >= 0.95 * pairs


def test_clusters_are_by_owner_and_in_order(spark):
    rows = [("b", 1, "red apples and green pears", 0.5), ("b", 2, "red apples and green pears too", 0.9), ("b", 3, "0123456789", None), ("a", 1, "x", 1.0), ("b", 4, "", 1.0)]
    found = {(x["owner"], x["cluster"]): (x["frequency"], x["representative"], x["avg_confidence"], x["significant"]) for x in udfs.clusters(spark.createDataFrame(rows, "owner string, seq long, prompt string, confidence double")).collect()}
    assert found == {("b", 0): (2, "red apples and green pears too", 0.7, False), ("b", 1): (1, "0123456789", 0.5, False), ("a", 0): (1, "x", 1.0, False)}


def test_chunks_and_answers_of_a_classifier(spark):
    assert udfs.model_chunks("a b.") == ["a b."]
    words = ["w"] * 299 + ["end."] + ["w"] * 310 + ["stop!"] + ["tail"]
    assert [len(c.split()) for c in udfs.model_chunks(" ".join(words))] == [300, 311, 1]
    rows = [(1, 0, [0.0, 0.0, 0.0, 100.0]), (1, 1, [0.0, 0.0, 0.0, 0.0]), (2, 0, [9.0, 0.0, 0.0, 0.0])]
    found = {x["doc_id"]: x for x in udfs.classified(spark.createDataFrame(rows, "doc_id long, place int, logits array<double>")).collect()}
    assert found[1]["ai_probability"] == 0.75 and found[1]["label"] == "ai" and found[1]["modal_bucket"] == "human" and found[2]["label"] == "human"


def test_page_text_takes_the_densest_block():
    long, short = "many words of text " * 20, "menu"
    page = f"<html><body><nav>{long}</nav><div id=a><div class='ad'>{long}</div><div><p>{long}</p><img src=x></div><a href='{'u' * 900}'>{short}</a></div><div class='cookie-bar'>{long}</div></body></html>"
    assert udfs.page_text(page) == long.strip()
    assert udfs.page_text(f"<body><article>one<script>x</script><p>two</p></article><div>{long}</div></body>") == "one\ntwo"
    assert udfs.page_text("<body>few<footer>x</footer></body>") == "few" and udfs.page_text("") == ""


def test_sections_and_writers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "intro\n# One\na\nb\n## Two ##x\nc"), (2, "p\n\nq"), (3, " \n "), (4, "#no\nx")], "doc_id long, text string")
    found = sorted(tuple(r) for r in readers.sections(docs).collect())
    assert found == [(1, 0, "Section 1", "intro"), (1, 1, "One", "a\nb"), (1, 2, "Two ##x", "c"), (2, 0, "Section 1", "p"), (2, 1, "Section 2", "q"), (4, 0, "Section 1", "#no\nx")]
    readers.write_documents(docs, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/sections").count() == 6
    assert readers.load_tables(readers.save_tables({"a": 1})) == {"a": 1}
    readers.save_snapshot(docs, str(tmp_path / "snap"), "x")
    assert readers.load_snapshot(spark, str(tmp_path / "snap"), "x").count() == 4
    parts = spark.createDataFrame([(1, 0, "Section 1", "t", "r", "accepted"), (1, 1, "Head", "u", "v", "open")], "doc_id long, section_order int, heading string, text string, rewrite string, status string")
    assert readers.markdown(parts).first()["markdown"] == "r\n\n---\n\n## Head\n\nu"
    lines = ["## PART 2: Words", "### Banned", "- delve", "* utilize", "text", "## PART 3", "- last"]
    rules = readers.guide_rules(spark.createDataFrame([("g", k, x) for k, x in enumerate(lines)], "guide string, n int, line string")).orderBy("n").collect()
    assert [(x["part"], x["heading"], x["rule"]) for x in rules] == [("2", "Banned", "delve"), ("2", "Banned", "utilize"), ("3", "", "last")]
    with pytest.raises(ValueError):
        readers.file_text("a.xyz", b"")


def test_settings_and_boilerplate():
    events = "select * from (values (1, timestamp '2024-01-29 23:00:00', 'view', '{\"k\": 5}'), (2, timestamp '2024-01-29 23:30:00', 'view', '{\"k\": 7}'), (3, timestamp '2023-01-01', 'error', '{\"k\": 9}')) t(event_id, ts, event_type, props)"
    assert sorted(run(corpus.s24(Duck()), [], events=events)) == [("error", "0", True), ("unset", "0", True), ("view", "7", False)]
    assert run(corpus.s25(Duck()), [], events=events) == [(1, "default", "7", "default")]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert run(corpus.t18(Duck()), [(1, "* Sure, here:\nThe  Cat\n"), (2, "Here"), (3, "Cats\nrest")]) == [(1, True, digest("the cat")), (2, False, digest("here")), (3, False, digest("cats rest"))]


def test_topics_of_paragraphs():
    texts = ["red cat cat and the dog", "red dog dog", "x", "blue bird sings red"]
    turns = " union all ".join(f"select 1 as conv_id, {k} as turn, '{t}' as text" for k, t in enumerate(texts))
    stop = set(profile.FUNCTION)
    words = [[w for w in t.split() if len(w) > 1 and w not in stop] for t in texts]
    terms = sorted({w for ws in words for w in ws})
    idf = {t: math.log((1 + len(words)) / (1 + sum(t in ws for ws in words))) + 1 for t in terms}
    rows = [[ws.count(t) * idf[t] for t in terms] for ws in words]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    unit = [[x / norm(r) for x in r] if any(r) else r for r in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    mean = [sum(u[k] for u in unit) / len(unit) for k in range(len(terms))]
    drift = sum(1 - dot(a, b) for a, b in zip(unit[:-1], unit[1:], strict=True)) / (len(unit) - 1)
    coherence = sum(dot(u, mean) / norm(mean) for u in unit) / len(unit)
    weights = sorted((sum(u[k] for u in unit) for k in range(len(terms))), reverse=True)
    found = run(vectors.topics(Duck()), [], conversations=turns)
    assert [r[0] for r in found] == [1] and found[0][1:] == pytest.approx([drift, coherence, sum(weights[: max(1, len(terms) // 5)]) / sum(weights)], abs=1e-6)


def test_detail_adds_up():
    sql = sentence.analysis(Duck(), detail=True)
    row = run(sql, [(1, "Furthermore, it is important to leverage robust, seamless, and holistic tools. Overall, we delve into the realm. " * 6)])[0]
    parts, raw, damp = row[11:16], row[16], row[17]
    assert raw == pytest.approx(min(100, sum(parts)), abs=1e-3) and row[6] == pytest.approx(raw - damp, abs=0.06) and raw > 20


def test_plain_searches_never_hide_a_pattern():
    r = random.Random(2)
    patterns = [L.NOT_ONLY, L.IT_IS_TO, L.TRIAD, L.SANDWICH, L.DUAL, L.TRAILING, L.ANY_PHRASE, *L.HEDGES, *L.TRANSITIONS, *L.DECLARATIONS, *L.DICHOTOMIES, *L.EXPOSITIONS, *(p for ps in L.SIGNATURE_PATTERNS.values() for p in ps)]
    words = sorted({w for p in patterns for n in dialect.needles(p) for w in n.split()} | {"the", "a", "cat", "and", "to", "it's", "don't", "is", "not"})
    texts = [" ".join(r.choice(words).capitalize() if r.random() < 0.2 else r.choice(words) for _ in range(r.randrange(2, 14))) + r.choice([".", ", and cat", ", resting."]) for _ in range(4000)]
    texts += ["It's not about cats, it's about dogs", "HERE'S THE THING", "Stop thinking and start doing", "a wave of sadness", "Not only cats but also dogs"]
    hit = 0
    for p in patterns:
        need = dialect.needles(p)
        for t in texts:
            if re.search(p, t, re.ASCII):
                hit += 1
                assert not need or any(n in t.lower() for n in need), (p, t)
    assert hit > 1000 and dialect.needles(r"\b(the|a)\s+\w+") == [] and dialect.needles("ab?c*|def") == []
