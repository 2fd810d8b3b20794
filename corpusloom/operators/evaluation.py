"""Retrieval quality: graded metrics, summaries, percentiles, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query, ndcg10, mrr, recall10, recall50), to 6 places, of rankings (query, rank, doc) and judgments (query, unit, grade, doc)."""
    exact = exact_metrics(rankings, judgments)
    return exact.select("query", *[F.round(c, 6).alias(c) for c in ("ndcg10", "mrr", "recall10", "recall50")])


def exact_metrics(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query, ndcg10, mrr, recall10, recall50, precision5, forbidden) without rounding: what means are taken of.

    A unit is credited once, at its first place; gain 2**grade - 1 for positive grades over log2(rank + 1);
    nDCG is 0 without an ideal, recall 1 without anything to find.  ``precision5`` is the share of the first five places
    that hold a document of a positive grade; ``forbidden`` counts documents of a negative grade among the first ten.
    """
    good = judgments.filter("grade > 0")
    found = rankings.join(good, ["query", "doc"]).groupBy("query", "unit", "grade").agg(F.min("rank").alias("rank"))
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    got = found.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        (1 / F.min("rank")).alias("mrr"), F.count_if(F.col("rank") <= 10).alias("f10"), F.count_if(F.col("rank") <= 50).alias("f50"),
    )
    units = good.select("query", "unit", "grade").distinct()
    place = units.withColumn("p", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "unit")))
    ideal = place.groupBy("query").agg(F.sum(F.when(F.col("p") <= 10, gain(F.col("grade")) / F.log2(F.col("p") + 1)).otherwise(0.0)).alias("ideal"), F.count(F.lit(1)).alias("units"))
    graded = rankings.join(judgments.groupBy("query", "doc").agg(F.max("grade").alias("best"), F.min("grade").alias("worst")), ["query", "doc"])
    seen = graded.groupBy("query").agg(F.count_if((F.col("rank") <= 5) & (F.col("best") > 0)).alias("good5"), F.count_if((F.col("rank") <= 10) & (F.col("worst") < 0)).alias("forbidden"))
    rows = judgments.select("query").distinct().join(ideal, "query", "left").join(got, "query", "left").join(seen, "query", "left")
    recall = lambda c: F.when(F.coalesce("units", F.lit(0)) == 0, 1.0).otherwise(F.coalesce(F.col(c), F.lit(0)) / F.col("units"))
    return rows.select(
        "query", F.when(F.coalesce("ideal", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg10"),
        F.coalesce("mrr", F.lit(0.0)).alias("mrr"), recall("f10").alias("recall10"), recall("f50").alias("recall50"),
        (F.coalesce("good5", F.lit(0)) / 5).alias("precision5"), F.coalesce("forbidden", F.lit(0)).alias("forbidden"),
    )


def summaries(scores: DataFrame, *groups: str) -> DataFrame:
    """Means of unrounded metrics for each group of each column, and overall, in one pass; missing values do not count.

    Metrics are added up as decimals of 12 places, so that the mean does not depend on the order of the rows.
    """
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(20,12)")).cast("double"), 6).alias(c)
    sets = scores.groupingSets([[F.col(g)] for g in groups] + [[]], *[F.col(g) for g in groups])
    return sets.agg(mean("ndcg10"), mean("mrr"), F.count(F.lit(1)).alias("n"))


def nearest_rank(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, value): the smallest value that at least ``share`` of the group's values do not exceed."""
    by = Window.partitionBy(group)
    ranked = rows.withColumn("_r", F.row_number().over(by.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(by))
    return ranked.filter(F.col("_r") == F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("_n")))).select(group, F.col(value).alias("value"))


class Mulberry32:
    """A 32-bit generator of uniform numbers, the same from any one seed."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        # The generator's published constants.
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = ((t ^ t >> 15) * (t | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296


def bootstrap(pairs: list[float], rounds: int = 1000, seed: int = 15) -> tuple[float, float, float]:
    """Mean difference and its 95 % interval, by resampling with replacement and nearest-rank percentiles."""
    n, draw = len(pairs), Mulberry32(seed)
    means = sorted(sum(pairs[int(draw() * n)] for _ in range(n)) / n for _ in range(rounds))
    pick = lambda p: means[max(0, -(-int(p * 1000) * rounds // 1000) - 1)]
    return sum(pairs) / n, pick(0.025), pick(0.975)


def paired_bootstrap(before: DataFrame, after: DataFrame, metric: str, rounds: int = 1000, seed: int = 15) -> DataFrame:
    """(metric, mean, low, high) of after - before, query by query: one number a judged query, a person's work to make."""
    spark = before.sparkSession
    rows = after.join(before.select("query", F.col(metric).alias("_b")), "query").orderBy("query").select((F.col(metric) - F.col("_b")).alias("d")).collect()
    if not rows:
        return spark.createDataFrame([], "metric string, mean double, low double, high double")
    return spark.createDataFrame([(metric, *bootstrap([r.d for r in rows], rounds, seed))], "metric string, mean double, low double, high double")


def freshness(artifact: Column, corpus: Column) -> Column:
    """missing, stale or fresh, by the corpus hash an artifact was made from."""
    return F.when(artifact.isNull(), "missing").when(artifact == corpus, "fresh").otherwise("stale")
