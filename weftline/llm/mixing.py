"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Targets of sources (source, source_size, source_docs): shares of all words by weight, none over max_epochs sizes.

    Sources take the weights in turn, by code point, null last. With sources in order of cap / weight, the clamped ones
    are a prefix; the first source that the level of the rest does not lift over its cap ends it, which is where
    clamping and resharing round by round would stop. The table has one row a source, so one task can order it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fullness = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    exact = lambda c: c.cast("decimal(19,0)")
    before = F.coalesce(F.sum("cap").over(fullness.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fullness.rowsBetween(0, Window.unboundedFollowing))
    spare = F.col("total") - F.col("before")
    fits = exact(spare) * exact(F.col("weight")) <= exact(F.col("cap")) * exact(F.col("left"))
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.size(cycle)) + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumns({"before": before, "left": left, "turn": F.row_number().over(fullness)})
        .withColumn("open", F.when(fits, F.struct("turn", (spare / F.col("left")).alias("level"))))
        .withColumn("level", F.min("open").over(everything)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "source_docs", "target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: int = 20, block_docs: int = 4096) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): size, source_size, target, copies and taken words.

    A source runs through its documents target / source_size times: whole passes take every document, and the rest of a
    pass takes documents in a seeded order until its share is reached. That order runs within blocks of about block_docs
    documents, so a hot source is many groups and each block misses its share by half a document at most.
    Null text has size 0; a null source is a source of its own; copies of a row rank side by side and count each.
    No rows, or no words at all, give targets of 0. Other columns of docs are not read.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    targets = fill_targets(sources, weights, max_epochs).withColumnRenamed("source", "of")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    blocks = F.ceil(F.col("source_docs") / block_docs).cast("long")
    block = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), blocks)
    in_block = Window.partitionBy("source", "block")
    so_far = in_block.orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    passes = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share = F.col("passes") - F.floor("passes")
    in_share = F.sum("size").over(so_far) * 2 - F.col("size") < share * 2 * F.sum("size").over(in_block)
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("digest", digest)
        .withColumns({"block": block, "passes": passes})
        .withColumn("copies", F.floor("passes") + F.when(in_share, 1).otherwise(0))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("long").alias("copies"), "source")
    )


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; see mix()."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_docs FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight, source_size * 3 AS cap, sum(source_size) OVER () AS total FROM src),
ranked AS (
  SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER w AS turn
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
lvl AS (SELECT arg_min((total - used)::DOUBLE / rest::DOUBLE, turn) AS level FROM ranked WHERE (total - used) * weight <= cap * rest),
targets AS (SELECT source, source_size, source_docs, least(cap::DOUBLE, level * weight) AS target FROM ranked, lvl),
dealt AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, md5('20:' || coalesce(d.doc_id::VARCHAR, '')) AS digest,
    ceil(t.source_docs / 4096)::BIGINT AS blocks, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS passes
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
put AS (SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT % blocks AS block FROM dealt),
cut AS (
  SELECT *, sum(size) OVER (PARTITION BY source, block ORDER BY digest, size ROWS UNBOUNDED PRECEDING) AS so_far,
    sum(size) OVER (PARTITION BY source, block) AS block_size FROM put)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, source FROM (
  SELECT *, (floor(passes) + CASE WHEN so_far * 2 - size < (passes - floor(passes)) * 2 * block_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM cut)
"""
