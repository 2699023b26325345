"""Operators against their SQL twins on the smallest tables, and boundary cases by hand."""

from __future__ import annotations

import io
import statistics
import zipfile
from pathlib import Path

import duckdb
import pytest

from inkspan import registry
from inkspan.functions.dialect import Duck, Spark
from inkspan.operators import document, sentence, udfs
from inkspan.sources import readers
from inkspan.streaming import stateful

SF = "/root/testdata/sf0.001"
MACHINE = " ".join(["In today's rapidly evolving digital landscape, it is important to leverage robust, seamless, and holistic frameworks.", "Furthermore, organizations must delve into transformative paradigms that foster innovation and underscore pivotal outcomes.", "Moreover, this comprehensive approach plays a crucial role in unlocking unprecedented value for every stakeholder.", "It is worth noting that the implications are far-reaching, and that a testament to synergy is clear.", "Ultimately, the key to success is to embark on a journey of meaningful and profound change."])
PERSON = "I didn't mean to stay in Leeds for 11 years. My cousin Tom rang on a wet Tuesday - well, honestly, he shouted - and said the flat's going, take it! So I took it. We hadn't got a kettle. Don't laugh. You'd have done it too, and by the way the rent was £90. Was it daft? Probably, but I can't say I'm sorry; the roof leaked (only over the bath, mind you) and we've still got Mrs Okafor's blue bucket."


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for t in registry.TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 4) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


CHECKED = ["h01_yules_k", "h05_zipf_deviation", "h09_char_ngram_profile", "h18_hedge_clusters", "h34_circular_repetition", "d5_structure", "d13_sentence", "c2_weighted_overall", "c6_genre", "v01_profile_elements", "a03_convergence", "a05_completeness", "f03_fidelity", "p08_profile_similarity", "s08_exists", "s10_retention", "s13_update_from", "s19_exact_duplicate", "t05_sentences", "t11_chunks", "l03_repetition_density", "l05_ngram_perplexity", "h42_semantic_monotony", "p03_exact_containment", "e01_label_summary", "e03_threshold_sweep", "k01_consolidate"]


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    got = sorted(([_norm(r[c]) for c in columns] for r in df.collect()), key=key)
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(([_norm(r[i]) for i in place] for r in want.fetchall()), key=key)


def _texts(spark, *texts):
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").createOrReplaceTempView("given_texts")


def test_machine_scores_above_person(spark):
    _texts(spark, MACHINE, PERSON)
    found = {r["doc_id"]: r for r in spark.sql(sentence.analysis(Spark(), "given_texts")).collect()}
    assert found[0]["overall_score"] > 35 > 25 > found[1]["overall_score"]
    assert found[1]["category"] == "clean" and found[0]["category"] != "clean"


def test_blank_and_null_texts_score_nothing(spark):
    _texts(spark, None, "", " \n ", "Short text.")
    for name in ("yules_k", "readability", "rhetorical_question_chain", "paragraph_uniformity"):
        f = document.SIGNALS[name][1]
        assert [tuple(r) for r in spark.sql(document.statement(Spark(), f(Spark()), {"score": "score"}, "given_texts")).collect()] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_severity_bands(spark):
    from inkspan.functions.dialect import severe

    rows = spark.sql("select " + ", ".join(severe(str(n)) for n in (0, 1, 2, 3, 4, 9))).first()
    assert list(rows) == [0, 0.25, 0.6, 0.6, 1, 1]


def test_every_signal_is_written_for_both_engines():
    for name, (_, f) in document.SIGNALS.items():
        assert list(f(Spark())) == list(f(Duck())), name


def test_welford_steps_match_statistics():
    values, state = [0.50, 0.51, 0.49, 0.50, 0.501, 0.500, 0.499], (0, 0.0, 0.0, 0.0, 0, -1)
    for k, v in enumerate(values):
        state = stateful.step(state, v, 1000 * (k + 1))
    assert state[1] == pytest.approx(statistics.mean(values))
    assert (state[2] / (len(values) - 1)) ** 0.5 == pytest.approx(statistics.stdev(values))
    assert state[4] >= 3 and state[5] > 0
    state = stateful.step(state, 0.80, 9000)
    assert state[4] == 0


def test_stream_of_updates(spark, tmp_path):
    rows = [("a", "e", k, v, 100 * k) for k, v in enumerate([0.5, 0.51, 0.49, 0.5, 0.5, 0.5])]
    schema = "owner string, element string, seq int, value double, words long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = stateful.converge(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("converged").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = spark.table("converged").collect()
    assert found[-1]["n"] == 6 and found[-1]["converged"]


def test_readers(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    found = {r["path"].rpartition("/")[2]: r["text"] for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert found == {"a.docx": "One\n\nTwo", "b.txt": "plain", "c.bin": None}


def test_sections(spark):
    docs = spark.createDataFrame([(1, "before\n# One\nx\n## Two\ny"), (2, "a\n\nb"), (3, "")], "doc_id long, text string")
    found = [tuple(r) for r in readers.sections(docs).orderBy("doc_id", "section_order").collect()]
    assert found == [(1, 0, "Section 1", "before"), (1, 1, "One", "x"), (1, 2, "Two", "y"), (2, 0, "Section 1", "a"), (2, 1, "Section 2", "b")]


def test_page_text():
    assert udfs.page_text("<html><body><nav>menu</nav><article><p>" + "word " * 60 + "</p></article><script>x</script></body></html>").startswith("word")
    assert udfs.page_text("") == ""


def test_near_duplicates(spark):
    base = PERSON
    docs = spark.createDataFrame([(1, "s", base), (2, "s", base.replace("kettle", "teapot")), (3, "t", base), (4, "s", "unrelated"), (5, "s", None)], "doc_id long, source string, text string")
    assert [tuple(r) for r in udfs.near_duplicates(docs).collect()] == [(2, 1)]


def test_near_duplicates_two_bands_apart(spark):
    start = " ".join(f"w{k:03d}" for k in range(100))
    docs = spark.createDataFrame([(k, "s", start + "z" * (n - len(start))) for k, n in enumerate((540, 568, 600))], "doc_id long, source string, text string")
    assert [tuple(r) for r in udfs.near_duplicates(docs).collect()] == [(1, 0)]


def test_versions_compare_as_numbers():
    assert readers.parse_version("1.10.0") > readers.parse_version("1.9.2")


def test_profiles_round_trip(spark):
    p = spark.createDataFrame([("a", "x", 0.5), ("a", "y", None)], "owner string, element string, weight double")
    back = readers.import_profile(readers.export_profile(p, ["owner"]), ["owner"], "element string, weight double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))
