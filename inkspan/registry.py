"""Queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.dialect import Duck, Spark
from inkspan.operators import corpus, document, guide, profile, sentence, udfs, vectors
from inkspan.plans.staging import removed, settled
from inkspan.sources import readers
from inkspan.streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql_over(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """Runs a statement in which tables of a folder stand as {name}: each becomes a view of that folder's file."""
    for t in TABLES:
        if f"{{{t}}}" in statement:
            view = f"{t}_{zlib.crc32(sf_dir.encode()):08x}"
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view)
            statement = statement.replace(f"{{{t}}}", view)
    if "inkspan_nfkc(" in statement:
        spark.udf.register("inkspan_nfkc", udfs.nfkc)
    return spark.sql(statement)


def add_sql(name: str, make: Callable[[Spark], str]) -> None:
    """A query that is one SQL statement, written once for both engines; tables stand in it by name."""

    measured = Spark()
    measured.measured = "{elements}"
    elements = "{elements}" in make(measured)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not elements:
            return sql_over(spark, sf_dir, make(Spark()))
        view = f"elements_{zlib.crc32(sf_dir.encode()):08x}"
        settled(profile.measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "elements").createOrReplaceTempView(view)
        return sql_over(spark, sf_dir, make(measured).replace("{elements}", view))

    QUERIES[name] = run
    text = make(Duck())
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    ORACLES[name] = text


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score of every document, counted by class and genre."""
    return QUERIES["analyze"](spark, sf_dir).groupBy("category", "genre").count()


for _name, (_id, _steps) in document.SIGNALS.items():
    add_sql(f"{_id}_{_name}", lambda d, f=_steps: document.statement(d, f(d), {"score": "score"}, "{documents}"))

_SENTENCE = ["d1_buzzwords", "d2_uniform", "d3_hedges", "d4_transitions", "d5_structure", "d6_dual_adjectives", "d7_trailing", "d8_declarations", "d9_dichotomies", "d10_expositions", "d11_phrases", "d12_fingerprint", "d13_sentence"]
for _name in _SENTENCE:
    add_sql(_name, lambda d, n=_name: sentence.statement(d, [n]) + f" select doc_id, cast(place as bigint) as place, cast({n} as double) as score from z_scored")
add_sql("c2_weighted_overall", lambda d: sentence.units(d, "{documents}", "doc_id") + " select doc_id, round(overall, 6) as overall, cast(sentences as bigint) as sentences from z_units")
add_sql("c6_genre", lambda d: document.statement(d, document.genre_steps(d), {"genre": "genre", "best": "round(cast(g_best as double), 6)"}, "{documents}"))
add_sql("analyze", sentence.analysis)
add_sql("c17_detail", lambda d: sentence.analysis(d, detail=True))

for _name, _make in {
    "v01_profile_elements": profile.element_query, "a01_stack_resolution": profile.stacked, "a02_corpus_average": profile.averaged, "a03_convergence": profile.convergence, "a05_completeness": profile.completeness, "a05_categories": profile.categories, "e10_best_format": profile.best_format,
    "a06_starter_milestone": profile.milestone, "f03_fidelity": profile.fidelity, "f04_lowest_gaps": profile.gaps, "p08_profile_similarity": profile.similarity,
}.items():
    add_sql(_name, _make)

for _name, _make in (corpus.QUERIES | guide.QUERIES | vectors.QUERIES).items():
    add_sql(_name, _make)


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _text_score(udf) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", udf("text").alias("score"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as the original, the turn after it as its rewrite."""
    turns = _docs(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.selectExpr("conv_id", "turn - 1 as turn", "text as rewrite")
    return turns.join(after, ["conv_id", "turn"]).selectExpr("concat(conv_id, ':', turn) as id", "text as original", "rewrite")


def chunked_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H43, a view at a time: as one statement it would be nested too deep."""
    names = [f"{x}_{zlib.crc32(sf_dir.encode()):08x}" for x in ("chunks", "chunk_scores")]
    settled(sql_over(spark, sf_dir, corpus.chunk_rows(Spark())), "chunks").createOrReplaceTempView(names[0])
    spark.sql(sentence.analysis(Spark(), names[0])).createOrReplaceTempView(names[1])
    return sql_over(spark, sf_dir, corpus.chunk_spread(Spark(), names[1]))


def semantic_monotony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H42 within each row: as SQL, every word of the corpus is shuffled several times."""
    d = Spark()
    steps = document.needed(document.base(d) | {"sentences": d.map("s5", "z_s", d.extract("lower(z_s)", r"[\p{L}\p{N}_]+"))}, "sentences")
    rows = sql_over(spark, sf_dir, document.layered(d, steps, "{documents}", "doc_id, case when doc_id is not null then text end as text") + " select cast(doc_id as bigint) as doc_id, case when t0 <> '' then sentences end as sentences from z_end")
    score = "cast(case when n >= 4 and sim > 0.12 then round((sim - 0.12) / 0.88 * 40) else 0 end as double)"
    return udfs.similarities(rows).selectExpr("doc_id", "round(case when n >= 4 then sim end, 6) as similarity", f"{score} as score")


def analyze_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score with all document signals: those that need a library or other rows are worked out first, by document."""
    key = f"{zlib.crc32(sf_dir.encode()):08x}"
    columns = sentence.OUTSIDE.values()
    by_doc = lambda name: QUERIES[name](spark, sf_dir).select("doc_id", F.col("score").alias(sentence.OUTSIDE[name.partition("_")[2]]))
    own = _docs(spark, sf_dir).select("doc_id", udfs.compression_udf("text").alias("x_compression_ratio"), udfs.hollow_udf("text").alias("x_hollow_informality"))
    parts = own.unionByName(by_doc("h42_semantic_monotony"), True).unionByName(by_doc("h43_chunked_consistency"), True)
    settled(parts.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns)), "signals").createOrReplaceTempView(f"signals_{key}")
    removed(spark.table(f"chunks_{key}"))
    return sql_over(spark, sf_dir, sentence.analysis(Spark(), outside=sentence.OUTSIDE, beside=f"signals_{key}"))


QUERIES |= {
    "h42_semantic_monotony": semantic_monotony,
    "h06_compression_ratio": _text_score(udfs.compression_udf),
    "h35_hollow_informality": _text_score(udfs.hollow_udf),
    "l02_compression_document": _text_score(udfs.joint_compression_udf),
    "l01_compression_sentence": lambda s, d: sql_over(s, d, sentence.rows(Spark(), "{documents}") + " select doc_id, cast(place as bigint) as place, sentence from z_rows").select("doc_id", "place", udfs.sentence_compression_udf("sentence").alias("score")),
    "i09_page_text": lambda s, d: _docs(s, d, "pages").select("page_id", udfs.page_text_udf("html").alias("text")),
    "t10_sections": lambda s, d: readers.sections(_docs(s, d)),
    "p02_near_duplicates": lambda s, d: udfs.near_duplicates(_docs(s, d), "lang"),
    "p05_clusters": lambda s, d: udfs.clusters(_docs(s, d, "conversations").selectExpr("cast(conv_id as string) as owner", "turn as seq", "text as prompt", "0.5D as confidence")),
    "p03_ngram_overlap": lambda s, d: udfs.ngram_overlap(_answers(s, d)),
    "t12_model_chunks": lambda s, d: udfs.chunks(_docs(s, d)).selectExpr("doc_id", "place", "size(split(trim(chunk), ' ')) as words", "sha2(chunk, 256) as digest"),
    "h43_chunked_consistency": chunked_consistency,
    "analyze_full": lambda s, d: analyze_full(s, d),
    "st01_windowed_events": lambda s, d: stateful.windowed(_docs(s, d, "events")),
}
ORACLES["h43_chunked_consistency"] = corpus.h43(Duck())
for _t in TABLES:
    ORACLES["h43_chunked_consistency"] = ORACLES["h43_chunked_consistency"].replace(f"{{{_t}}}", _t)
ORACLES["st01_windowed_events"] = "select date_trunc('day', ts) as start, event_type, count(*) as n, sum(value) as total from events group by all"
