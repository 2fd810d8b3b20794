"""Mixing sources to target weights, on DataFrame functions alone.

Every document gets a seeded hash key.  Within its source the documents are range-sorted by the key,
word counts are accumulated by distributed prefix sums, and the source is cut at its exact budget;
a budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import blind_digest, buckets_for, hashed_side, prefix_sums, ranked_sources, shuffle_key, staged, unit, unused, word_count


def source_targets(stats: DataFrame, weights: Sequence[int], share: float, epochs: float) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, source_rows).

    The sources, by code point with null last, weigh ``weights`` in turn and share ``share`` times all
    words.  A target stops at ``epochs`` times its source's size; what is over is shared anew by
    weight until none is above.  That fixed point is one level L with target = min(cap, weight * L):
    in order of cap / weight, L is the first level that the next source can hold, the sources before it being full.
    Later levels count sources as full that are not, and are lower: L is the highest level that fits.
    """
    ranked = ranked_sources(stats)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", turn).withColumn("_cap", F.lit(float(epochs)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(from_here)
    fits = F.when(level <= F.col("_cap") / F.col("_weight"), level)
    ranked = ranked.withColumn("_fits", fits)
    ranked = ranked.withColumn("_level", F.max("_fits").over(everything))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.col("_level")))
    return ranked.withColumn("target", F.round(target, 6)).drop("_weight", "_cap", "_fits", "_level")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: float = 2, seed: str = "mix") -> DataFrame:
    """How many words the mixture takes of each document.

    Takes the columns doc_id, text and source; others are not read.  Returns doc_id, source, size,
    source_size, target, taken and copies.  ``taken`` counts repeats and is exact to the word: the words
    taken of a source add up to floor(target).  ``copies`` is the same decision for whole documents: the
    full epochs, and one more where at least half of the document lies before the cut.  A null text has
    size 0, a null source is a source of its own.  A null doc_id is drawn by its text.  Rows with the same doc_id
    are separate rows; those alike in doc_id, text and source are placed as one and told apart afterwards, so that
    no task holds them all.  An empty table gives an empty result.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), blind_digest("doc_id", "text")), "mix-sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(stats, weights, share, epochs).withColumnRenamed("source", "_source")
    rows = sized.groupBy("doc_id", "source", "size", "_digest").agg(F.count(F.lit(1)).alias("_alike"))
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["_source"])).drop("_source")
    rows = rows.withColumn("_key", shuffle_key(F.col("doc_id"), seed, F.col("_digest"))).withColumn("_mass", F.col("size") * F.col("_alike"))
    rows = rows.withColumn("_bucket", F.floor(unit(F.col("_key")) * buckets_for(F.col("source_rows"))))
    rows = prefix_sums(rows, ["_rank"], "_bucket", ["_key", "doc_id", "size"], "_mass", "_before")
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0), F.col("_alike") - 1)))
    rows = rows.withColumn("_before", F.col("_before") + F.col("_nth") * F.col("size"))
    whole = F.floor(F.col("target")).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("_rounds", rounds.cast("long")).withColumn("_rest", whole - F.col("_rounds") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    once_more = (2 * part >= F.col("size")) & (F.col("_before") < F.col("_rest"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_rounds") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("_rounds") + once_more.cast("long")).alias("copies"),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture, whole, each as often as it is taken, with the columns of ``docs``, whatever their names.

    Documents are matched to their decision by doc_id; rows that share a doc_id take the largest.
    """
    id_, copies, copy = unused(docs, "_mix_id"), unused(docs, "_mix_copies"), unused(docs, "_mix_copy")
    wanted = mix(docs, **how).groupBy(F.col("doc_id").alias(id_)).agg(F.max("copies").cast("int").alias(copies)).filter(F.col(copies) > 0)
    wanted = staged(wanted, "mix-decisions")
    # The table of decisions is hashed, so that the texts are dealt but not sorted.
    joined = docs.join(hashed_side(wanted, wanted.count()), docs["doc_id"].eqNullSafe(wanted[id_]))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def query(spark, sf_dir):
    from corpusloom.llm.common import documents

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS digest FROM documents),
stats AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM stats),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM stats)
    - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (
  SELECT source, source_size, round(least(cap, w * (SELECT max(level) FROM levels WHERE level <= cap / w)), 6) AS target FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS whole,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY CASE WHEN doc_id IS NULL THEN md5('mix::' || digest) ELSE md5('mix:' || CAST(doc_id AS VARCHAR)) END, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE whole // source_size * size + greatest(0, least(size, whole % source_size - before)) END AS BIGINT) AS taken
FROM placed
"""
