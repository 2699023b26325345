"""The registered queries of this folder: thin digests of what the operators return, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import curriculum, embedding_join, licenses, ngram_join, packing, pieces, quality, toxicity, transport, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Where the public tokenizers' files are, unless spark.inkspan.tokenizers says otherwise; operators take any vocabulary or model.
TOKENIZERS = "/opt/tokenizers"


def tokenizer(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.inkspan.tokenizers', TOKENIZERS)}/{name}"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_pack_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(_read(spark, sf_dir, "documents"), vocabulary=packing.ranked(tokenizer(spark, "byte_bpe_50k.tiktoken")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes of pages are those labels.quality whose doc_id is the page's id."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_filter.judge(pages, pages.join(labels, "page_id")).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``; one that begins with a notice is the licence file of its directory."""
    docs = _read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    out = licenses.scan(docs.select(path.alias("path"), "text"), F.col("line") == 0)
    return out.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "path", "licence", "origin", F.round("cosine", 6).alias("cosine"), "from_directory")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.classes(_read(spark, sf_dir, "embeddings"))


def op8_media_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_digests(_read(spark, sf_dir, "documents"))


def op9_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum.curriculum(_read(spark, sf_dir, "documents"))
    return out.withColumns({"target": F.round("target", 3), "position": F.round("position", 9)})


def op10_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"), pieces.Model.load(tokenizer(spark, "piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_pack_token_ids": op2_pack_token_ids,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity_noisy_channel": op4_toxicity_noisy_channel,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_media_transport_stream": op8_media_transport_stream,
    "op9_mix_curriculum": op9_mix_curriculum,
    "op10_sentencepiece_n_best": op10_sentencepiece_n_best,
}
ORACLES: dict[str, str] = {"op3_url_filter": url_filter.ORACLE, "op9_mix_curriculum": curriculum.ORACLE}
