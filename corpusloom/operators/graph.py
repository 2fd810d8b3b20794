"""Knowledge-graph look-ups over entities, mentions, edges and relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.staging import written

GENERIC_MENTIONS, ANSWER_CAP, VARIANT_CAP, RELATED_CAP, CO_MENTION_LEAST, EVIDENCE = 1000, 6, 4, 8, 2, 3
#: Pairs that one task counts.
PAIRS_PER_TASK = 2_000_000


def informativeness(mentions: Column) -> Column:
    return 1 / F.log2(2 + mentions)


def mention_counts(postings: DataFrame) -> DataFrame:
    """(entity, mentions): the sections that mention each entity."""
    return postings.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))


def entity_weights(postings: DataFrame, entities: DataFrame, hopped: DataFrame | None = None) -> DataFrame:
    """(entity, weight, direct) of the asked entities, and at half weight of those one edge away."""
    wanted = entities.select("entity", F.lit(True).alias("direct"))
    if hopped is not None:
        wanted = wanted.unionByName(hopped.select("entity").distinct().join(entities, "entity", "left_anti").select("entity", F.lit(False).alias("direct")))
    counted = mention_counts(postings.join(F.broadcast(wanted.select("entity")), "entity", "left_semi"))
    weight = informativeness(F.col("mentions")) * F.when(F.col("direct"), 1.0).otherwise(0.5)
    return wanted.join(counted, "entity").select("entity", weight.alias("weight"), "direct")


def candidates(postings: DataFrame, weights: DataFrame, limit: int = 20) -> DataFrame:
    """Sections by how many asked entities they cover, then by the sum of weight * log2(1 + count), then by id.

    The asked entities are a query's, a handful, and so are hashed; postings (entity, section, count) are not.
    """
    rows = postings.join(F.broadcast(weights), "entity")
    total = F.round(F.sum(F.col("weight") * F.log2(1 + F.col("count"))), 6)
    found = rows.groupBy("section").agg(F.count_if("direct").alias("coverage"), total.alias("score"))
    return found.orderBy(F.desc("coverage"), F.desc("score"), "section").limit(limit)


def one_hop(edges: DataFrame, entities: DataFrame, relations: Sequence[str]) -> DataFrame:
    """Subjects of edges (s, r, o) of the given relations into the asked entities."""
    into = edges.filter(F.col("r").isin(list(relations))).join(F.broadcast(entities.select(F.col("entity").alias("o"))), "o")
    return into.select(F.col("s").alias("entity")).distinct()


def reranked(ranked: DataFrame, signal: str, weight: float = 0.5) -> DataFrame:
    """Within each run of rows of one tier, by score * (1 + weight * signal / the run's largest signal); ties stay."""
    before = F.lag("tier").over(Window.orderBy("rank"))
    rows = ranked.withColumn("_new", (~before.eqNullSafe(F.col("tier"))).cast("int"))
    rows = rows.withColumn("block", F.sum("_new").over(Window.orderBy("rank")))
    most = F.max(signal).over(Window.partitionBy("block"))
    key = F.round(F.col("score") * (1 + F.when(most > 0, weight * F.col(signal) / most).otherwise(0.0)), 9)
    return rows.withColumn("key", key).withColumn("position", F.row_number().over(Window.orderBy("block", F.desc("key"), "rank"))).drop("_new")


def co_mentions(postings: DataFrame, least: int = CO_MENTION_LEAST) -> DataFrame:
    """(a, b, n) of entities (a < b) that at least ``least`` sections mention together.

    Pairs are made within a section, from one list of its entities; they are counted in as many partitions as
    hold ``PAIRS_PER_TASK`` each, so that what one task counts does not grow.
    """
    once = postings.filter(F.col("section").isNotNull()).select("section", "entity").distinct()
    lists = written(once.groupBy("section").agg(F.sort_array(F.collect_list("entity")).alias("e")).filter(F.size("e") > 1).select("e"))
    many = lists.agg(F.sum(F.size("e").cast("long") * (F.size("e") - 1) / 2)).head()[0] or 0
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(many) // PAIRS_PER_TASK))
    heads = lists.select(F.posexplode("e").alias("i", "a"), "e")
    pairs = heads.select("a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    return pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def both_directions(edges: DataFrame) -> DataFrame:
    """(node, other, direction): each citation from both ends."""
    out = edges.select(F.col("s").alias("node"), F.col("o").alias("other"), F.lit("cites").alias("direction"))
    return out.unionByName(edges.select(F.col("o").alias("node"), F.col("s").alias("other"), F.lit("cited_by").alias("direction")))


def related(sources: Sequence[DataFrame], cap: int = RELATED_CAP) -> DataFrame:
    """(section, reason, place): frames (section, strength) in order of precedence; the first reason of a section counts."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [f.select("section", "strength", F.lit(i).alias("reason")) for i, f in enumerate(sources)])
    best = rows.withColumn("_p", F.row_number().over(Window.partitionBy("section").orderBy("reason", F.desc("strength")))).filter("_p = 1")
    top = best.orderBy("reason", F.desc("strength"), "section").limit(cap)
    return top.select("section", "reason", "strength", F.row_number().over(Window.orderBy("reason", F.desc("strength"), "section")).alias("place"))


def longest_aliases(docs: DataFrame, aliases: DataFrame, most_words: int = 5) -> DataFrame:
    """(id, entity): greedy left-to-right matches of aliases (alias, entity), at each word the longest.

    Candidates come from an equi-join of the texts' word spans with the aliases; the greedy choice folds over a
    document's few matches.  Of several entities of one alias the smallest is taken.  Spans are many times the
    size that Spark reckons from the files: they are dealt out before they are made and never broadcast.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size("words") - at)), lambda n: F.struct(at.alias("at"), n.alias("n"), F.array_join(F.slice("words", at + 1, n), " ").alias("alias")))
    grams = docs.select("id", "words").repartition(parts, "id").select("id", F.explode(F.flatten(F.transform("words", lambda w, at: spans(at)))).alias("g")).select("id", "g.*")
    hits = grams.hint("merge").join(aliases, "alias")
    listed = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("n")).alias("less"), "entity"))).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("taken"))
    step = lambda acc, h: F.when(h["at"] < acc["free"], acc).otherwise(F.struct((h["at"] - h["less"]).alias("free"), F.concat(acc["taken"], F.array(h["entity"])).alias("taken")))
    return listed.select("id", F.explode(F.array_distinct(F.aggregate("hits", start, step)["taken"])).alias("entity"))


def relation_matches(relations: DataFrame, stems: Sequence[str]) -> DataFrame:
    """Relations (name, stems) all of whose stems the query has."""
    return relations.filter((F.col("name") != "related_to") & (F.size(F.array_except("stems", F.array(*[F.lit(s) for s in stems]))) == 0)).select("name")


def triple_answers(edges: DataFrame, subject, relation: Column, cap: int = ANSWER_CAP) -> DataFrame:
    """Objects of a subject's matching edges, those with most evidence first."""
    found = edges.filter((F.col("s") == subject) & relation).groupBy("r", "o").agg(F.count(F.lit(1)).alias("evidence"))
    return found.orderBy(F.desc("evidence"), "r", "o").limit(cap)
