"""Mixing sources to target weights by a time-varying curriculum [DataFrame functions only].

Each source has a weight schedule over training time u in [0, 1] that rises or falls linearly; its integral up to u,
scaled to the source's target, is the number of its words that training has asked for by then. A document's words
stand at a known place in its source's order, so inverting that cumulative demand gives the time at which the document
is due: its position. Documents come in the order of md5(doc_id), pass after pass; the last pass stops at the target.

A source may hold any share of the rows: no source is ever gathered in one task. Each source is cut by the first
digits of the hash into ``BUCKETS`` runs; running sums are taken inside a run, and run totals (one row each) are
added up apart. Only per-source rows (id, size, hash) are shuffled; texts follow in ``mixed``.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null doc_id hashes as the empty
text. Rows that repeat a doc_id are rows in their own right. A document of size 0 is due at the time of its place and
gives no words. An empty table gives an empty result. Other columns stay out of the way: working columns are prefixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights by rank of the source, repeating; words to mix as a share of all; most passes over a source.
WEIGHTS, SHARE, MOST_PASSES = (5.0, 2.0, 1.0), 1.5, 2
#: Slopes of the schedules by rank, repeating: early, even, late.
SLOPES = (-0.8, 0.0, 0.8)
BUCKETS = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _by_rank(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """Words, rank, target and slope of each source.

    Targets are in proportion to the weights and add up to ``share`` of all words; none is above ``most`` times its
    source, what is cut off going to the others by weight. With sources in the order of what fills them (limit over
    weight), the first k are full when the remaining words by weight would pass the k-th limit: one sort settles it.
    The table has a row for each source, never for each document.
    """
    by = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    by = by.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    by = by.withColumn("_weight", _by_rank(weights, F.col("_rank"))).withColumn("_limit", most * F.col("_source_size"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumns({"_left": F.lit(share) * F.sum("_source_size").over(whole) - F.sum("_limit").over(upto) + F.col("_limit"), "_open": F.sum("_weight").over(whole) - F.sum("_weight").over(upto) + F.col("_weight")})
    by = by.withColumn("_level", F.greatest(F.lit(0.0), F.col("_left") / F.col("_open")))
    # The level is that of the first source which it does not fill; sources before it are full.
    by = by.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct((F.col("_limit") / F.col("_weight")).alias("k"), F.col("_rank"), F.col("_level").alias("level")))).over(whole)["level"])
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_weight"))
    return by.select("_source", "_source_size", target.alias("_target"), _by_rank(SLOPES, F.col("_rank")).alias("_slope"))


def due(done: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's demand reaches ``done`` words: the inverse of target * (u + slope * (u^2 - u) / 2)."""
    x = F.least(F.lit(1.0), F.when(target > 0, done / target).otherwise(0.0))
    b = 1 - slope / 2
    return F.when(slope == 0, x).otherwise((-b + F.sqrt(F.greatest(F.lit(0.0), b * b + 2 * slope * x))) / slope)


def places(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each row of ``docs`` with its size, its source's size and target, where its words begin in its source, and what is taken."""
    names = {c: f"_keep_{c}" for c in keep}
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("source").alias("_source"), n_words(F.col("text")).alias("_size"), hashed.alias("_hash"))
    rows = rows.withColumn("_bucket", F.conv(F.substring("_hash", 1, 2), 16, 10).cast("int") % BUCKETS)
    runs = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_run_size"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_run_at", F.coalesce(F.sum("_run_size").over(before), F.lit(0)))
    targets = source_targets(rows.select("_source", "_size"))
    # Null-safe keys as plain ones, so that the joins below shuffle or broadcast by size instead of comparing all pairs.
    key = lambda df: df.withColumn("_key", F.concat(F.when(F.col("_source").isNull(), "0").otherwise("1"), F.coalesce("_source", F.lit(""))))
    plan = key(runs).join(key(targets).drop("_source"), "_key").select("_key", "_bucket", "_run_at", "_source_size", "_target", "_slope")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_hash", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = key(rows).withColumn("_in_run", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    at = F.col("_run_at") + F.col("_in_run")
    words = F.floor(F.col("_target") + F.lit(0.5))
    passes = [F.greatest(F.lit(0), F.least(F.col("_size"), words - k * F.col("_source_size") - F.col("_at"))) for k in range(MOST_PASSES)]
    out = rows.join(plan, ["_key", "_bucket"]).withColumn("_at", at).withColumn("_passes", F.array(*passes))
    return out.withColumn("_taken", F.aggregate("_passes", F.lit(0).cast("long"), lambda a, x: a + x))


def curriculum(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the position in training of each document's first words, sorted by it."""
    p = places(docs)
    out = p.select(
        F.col("_keep_doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"),
        F.when((F.col("_taken") > 0) | (F.col("_at") <= F.col("_target")), due(F.col("_at"), F.col("_target"), F.col("_slope"))).alias("position"),
    )
    return out.orderBy("position", "doc_id")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` in training order, once for each pass that takes at least half of their words."""
    p = places(docs, docs.columns)
    p = p.select("*", F.posexplode("_passes").alias("_pass", "_words")).where((F.col("_words") > 0) & (2 * F.col("_words") >= F.col("_size")))
    p = p.withColumn("_position", due(F.col("_at") + F.col("_pass") * F.col("_source_size"), F.col("_target"), F.col("_slope")))
    return p.orderBy("_position", "_hash").select(*(F.col(f"_keep_{c}").alias(c) for c in docs.columns))


ORACLE = """
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
by1 AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
by2 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM by1),
by3 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  CASE (rank - 1) % 3 WHEN 0 THEN -0.8::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS slope, 2 * source_size AS lim FROM by2),
by4 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - sum(lim) OVER w + lim AS remaining, sum(weight) OVER () - sum(weight) OVER w + weight AS unfilled
  FROM by3 WINDOW w AS (ORDER BY lim / weight, rank ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT arg_min(level, (k, rank)) AS level FROM (
  SELECT greatest(0.0::DOUBLE, remaining / unfilled) AS level, lim / weight AS k, rank, weight, lim FROM by4) WHERE level * weight <= lim),
tgt AS (SELECT source, source_size, slope, least(lim::DOUBLE, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM by4, lev),
placed AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.slope, floor(t.target + 0.5) AS words,
  coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM rows r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source),
took AS (SELECT *, (greatest(0, least(size, words - pos)) + greatest(0, least(size, words - source_size - pos)))::BIGINT AS taken,
  least(1.0::DOUBLE, CASE WHEN target > 0 THEN pos / target ELSE 0.0 END) AS x FROM placed)
SELECT doc_id, size, source_size, round(target, 3) AS target, taken,
  CASE WHEN taken > 0 OR pos <= target THEN round(CASE WHEN slope = 0 THEN x ELSE (-(1 - slope / 2) + sqrt(greatest(0.0, (1 - slope / 2) * (1 - slope / 2) + 2 * slope * x))) / slope END, 9) END AS position
FROM took
"""
