"""One small test for each finding of round 2 that was settled in the code."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import numpy as np
import pytest

from inkspan import registry
from inkspan.functions.dialect import Duck, Spark
from inkspan.llm import ngram_join, pieces
from inkspan.llm import queries as llm_queries
from inkspan.operators import corpus, guide, profile, sentence, udfs

BESIDE = "éthe old man and éan odd cat went home today with nobody at all to see them."


@pytest.mark.parametrize("name", ["d5_structure", "d13_sentence"])
def test_word_borders_beside_accented_letters(spark, name):
    """A border beside an accented letter is one for both engines."""
    spark.createDataFrame([(1, BESIDE)], "doc_id long, text string").createOrReplaceTempView("border_texts")
    end = f" select cast({name} as double) as score from z_scored"
    got = spark.sql(sentence.statement(Spark(), [name], "border_texts") + end).first()[0]
    c = duckdb.connect()
    c.sql("create table border_texts (doc_id bigint, text varchar)")
    c.execute("insert into border_texts values (1, ?)", [BESIDE])
    assert got == c.sql(sentence.statement(Duck(), [name], "border_texts") + end).fetchall()[0][0] > 0


def test_op1_common_passages_dont_chain_groups(spark):
    """pairs of near copies that all hold one common passage stay families of their own, and are found."""
    common = " ".join(f"c{k}" for k in range(12))
    rows = []
    for g in range(150):
        own = [f"w{g}x{k}" for k in range(60)]
        rows += [(2 * g, " ".join(own) + " " + common), (2 * g + 1, " ".join(own) + " " + common + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sizes = [r["count"] for r in ngram_join.families(docs).groupBy("family").count().collect()]
    assert sizes == [2] * 150
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs).collect()} == {i: i - i % 2 for i, _ in rows}


def test_h42_moves_no_words(spark, tmp_path):
    """F2: scores come row by row, without an exchange, and agree with SQL on odd rows."""
    texts = [None, "", "  \n ", "One. Two. One. Two.", "... !!! --- ...", "A a b. ! A b c. C d! " * 9, "The cat sat.\n\nThe cat sat.\n\nA dog ran off?\n\nThe cat sat on a dog.", "Só é. Só é, não? Não é. É só não."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["h42_semantic_monotony"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(f"select doc_id, similarity, score from ({registry.ORACLES['h42_semantic_monotony']})").fetchall()
    assert sorted(map(tuple, found.select("doc_id", "similarity", "score").collect())) == sorted(want)


def test_p03_pairs_of_runs_are_compared_together(spark, monkeypatch):
    """all pairs of runs go through the comparison together, with the results of one pair at a time, in blocks of any size."""
    texts = ["", "a", "kitten", "sitting", "é" * 70, "x" * 64, "x" * 63 + "y", "y" + "x" * 64, "ab" * 40, "ab" * 39 + "ba", "漢字 kitten"]
    one, two = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    assert udfs.likenesses(texts, one, two).tolist() == [udfs.likeness(texts[i], texts[j]) for i, j in zip(one, two, strict=True)]
    original = "the cat sat on the mat and " + " ".join(f"word{k} kitten" for k in range(30))
    rewrite = "the cats sat upon the mats and " + " ".join(f"wort{k} sitting" for k in range(30))
    want = udfs.overlap_of(original, rewrite)
    monkeypatch.setattr(udfs, "SIDE", 5)
    monkeypatch.setattr(udfs, "AT_ONCE", 3)
    assert udfs.overlap_of(original, rewrite) == want


def _both(spark, make, values):
    c = duckdb.connect()
    return [spark.sql(f"select {make(Spark(), f'{v!r}D')}").first()[0] for v in values], [c.sql(f"select {make(Duck(), f'{v!r}::double')}").fetchall()[0][0] for v in values]


def test_k02_weights_in_words_round_as_in_sql(spark):
    """0.545 and 0.575 are no halves once they are scaled."""
    got, want = _both(spark, lambda d, x: guide.fixed(d, x, 2), [0.545, 0.575, 0.125, 0.375, 0.1, 1.0])
    assert got == want == ["0.55", "0.57", "0.12", "0.38", "0.10", "1.00"]


def test_a03_weights_round_as_in_sql(spark):
    """what is a half in decimals needn't be one as a scaled double."""
    values = [4.42625, 7.04525, 0.26785, 1.00005, 0.00015, 123.45675, -0.00025, 2.5, 0.0]
    got, want = _both(spark, lambda d, x: d.rounded(x, 4), values)
    assert got == want
    assert got != [spark.sql(f"select round({v!r}D, 4)").first()[0] for v in values]


def test_p02_compares_up_to_the_first_like_text(spark, tmp_path, monkeypatch):
    """of a group of near copies each is compared with as many texts as it takes to find the first like one."""
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*words[:40], f"x{k}y", *words[41:]]), "s") for k in range(30)]
    log, alike = tmp_path / "compared", udfs._alike

    def counted(x, y):
        with log.open("a") as f:
            f.write("x")
        return alike(x, y)

    monkeypatch.setattr(udfs, "_alike", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["first_id"] for r in udfs.near_duplicates(docs).collect()}
    assert found == dict.fromkeys(range(1, 30), 0)
    assert len(log.read_text()) == 29


def test_c12_blends_round_as_in_sql(spark, monkeypatch):
    """a blend that is a half in decimals needn't be one as a scaled double; every score of one digit, label and kind of id."""
    rows = [(2 * k + odd, label, k / 10) for k in range(1001) for odd in (0, 1) for label in (0, 1)]
    monkeypatch.setattr(corpus, "scored", lambda d: "with z_x as (select * from blend_scores)")
    spark.createDataFrame(rows, "doc_id long, label int, score double").createOrReplaceTempView("blend_scores")
    c = duckdb.connect()
    c.sql("create table blend_scores as select 2 * k + odd as doc_id, label::int as label, k / 10.0::double as score from range(1001) a(k), range(2) b(odd), range(2) c(label)")
    want = c.sql(corpus.c12(Duck())).fetchall()
    assert sorted(map(tuple, spark.sql(corpus.c12(Spark())).collect())) == sorted(want)


def test_analyze_full_moves_no_text(spark, tmp_path, monkeypatch):
    """signals from outside meet scores, not texts: no exchange has texts in it, and the chunks of H43 are gone."""
    texts = [None, "", "One. Two.", "It is worth noting that we utilize robust tools. The cat sat.\n\nA dog ran off? " * 9, "The cat sat on the mat today. " * 200]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables, settled = {}, registry.settled
    monkeypatch.setattr(registry, "settled", lambda df, name: tables.setdefault(name, settled(df, name)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.analyze_full(spark, str(tmp_path))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges, todo = [], [plan]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
        if node.nodeName() == "Exchange":
            exchanges.append(node.output().mkString(","))
    assert exchanges and not [x for x in exchanges if re.search(r"\btext#", x)]
    there = lambda name: [Path(f.removeprefix("file:")).exists() for f in tables[name].inputFiles()]
    assert not any(there("chunks")) and all(there("signals"))


def test_op10_walks_pieces_by_character():
    """op10: the tree that Viterbi walks, without a slice of the unit for each edge, holds every piece and nothing else."""
    model = pieces.Model.load(f"{llm_queries.TOKENIZERS}/piece_bpe_32k.model")
    found, todo = {}, [("", model.tree)]
    while todo:
        start, level = todo.pop()
        for c, (w, below) in level.items():
            if w:
                found[start + c] = w
            if below is not None:
                todo.append((start + c, below))
    assert found == {p: model.logp[k] for p, k in model.ids.items()}
    for unit in ("▁kitten", "▁▁", "漢字", "\x00é", "▁unseen" * 9):
        assert model.viterbi(unit)[0] == model.n_best(unit, 1)[0][0]


def test_w05_counts_syllables_once(spark):
    """vowels are looked for once, by distinct word, and what is made of them agrees with SQL."""
    assert profile.tall(Spark(), "syllable_texts").count("[aeiouy]+") == 1
    rows = [(k, " ".join([w, "The", "banana", "queue", "rhythm", "be", "Caféterie", "table,"][j % 8] + ("." if j % 9 == k else "") for j in range(230))) for k, w in enumerate(("one", "Énormément", "unbelievable"))]
    c = duckdb.connect()
    c.sql("create table syllable_texts (doc_id bigint, text varchar)")
    c.executemany("insert into syllable_texts values (?, ?)", rows)
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("syllable_texts")
    want = "flesch_kincaid_grade flesch_reading_ease gunning_fog_index smog_index".split()
    end = f" select doc_id, element, weight, value from z_tall where element in ({', '.join(repr(w) for w in want)})"
    got = spark.sql(profile.tall(Spark(), "syllable_texts") + end).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(profile.tall(Duck(), "syllable_texts") + end).fetchall()) and len(got) == 12
