"""Abbreviations, entity names and what a query may mean by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRENGTH_FLOOR, RESULT_CAP, VARIANT_CAP = 0.66, 20, 4


def curated(harvest: DataFrame, exclude: DataFrame, override: DataFrame, add: DataFrame) -> DataFrame:
    """(acronym, phrase, source): the harvest less the excluded, with corrected phrases, and with additions.

    The hand-kept lists are checked: an exclusion or correction of an acronym that was not harvested, and an
    addition of one that was, is an error of the lists and gets the source "unused".
    """
    kept = harvest.select("acronym", "phrase").join(exclude.select("acronym"), "acronym", "left_anti")
    fixed = kept.join(override.select("acronym", F.col("phrase").alias("better")), "acronym", "left")
    rows = fixed.select("acronym", F.coalesce("better", "phrase").alias("phrase"), F.when(F.col("better").isNull(), "harvested").otherwise("corrected").alias("source"))
    added = add.join(harvest.select("acronym"), "acronym", "left_anti").select("acronym", "phrase", F.lit("added").alias("source"))
    idle = exclude.select("acronym", F.lit(None).cast("string").alias("phrase")).unionByName(override.select("acronym", "phrase")).join(harvest.select("acronym"), "acronym", "left_anti")
    return rows.distinct().unionByName(added).unionByName(idle.select("acronym", "phrase", F.lit("unused").alias("source")))


def holds_run(words: Column, run: Column) -> Column:
    """The words of ``run`` stand next to each other, in order, in ``words``."""
    n = F.size(run)
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return (n > 0) & (n <= F.size(words)) & F.exists(places, lambda i: F.slice(words, i, n) == run)


def variants(entities: DataFrame, name: Sequence[str], cap: int = VARIANT_CAP) -> DataFrame:
    """Entities (entity, words) whose names hold the asked words as a run, shortest first, the asked name itself left out."""
    asked = F.array(*[F.lit(w) for w in name])
    found = entities.filter(holds_run(F.col("words"), asked) & (F.size("words") > len(name)))
    return found.orderBy(F.size("words"), "entity").limit(cap).select("entity")


def surfaces(entities: DataFrame, stems: Sequence[str], floor: float = STRENGTH_FLOOR) -> DataFrame:
    """(entity, strength): the share of the query's stems that an entity's surface words cover."""
    n = F.size(F.array_intersect(F.array(*[F.lit(s) for s in stems]), "words"))
    return entities.select("entity", F.round(n / F.lit(len(set(stems))), 6).alias("strength")).filter(F.col("strength") >= floor)


def related_results(kinds: Sequence[DataFrame], cap: int = RESULT_CAP) -> DataFrame:
    """(section, kind, strength, place): of frames (section, strength), most telling kind first, each section's best row."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [f.select("section", "strength", F.lit(i).alias("kind")) for i, f in enumerate(kinds)])
    best = rows.groupBy("section").agg(F.min(F.struct("kind", (-F.col("strength")).alias("less"))).alias("b"))
    out = best.select("section", F.col("b.kind").alias("kind"), (-F.col("b.less")).alias("strength")).orderBy("kind", F.desc("strength"), "section").limit(cap)
    return out.withColumn("place", F.row_number().over(Window.orderBy("kind", F.desc("strength"), "section")))


def lexicon(named: DataFrame) -> DataFrame:
    """(name, entity): folded names that one entity alone has."""
    from corpusloom.functions.text import fold

    rows = named.select(fold(F.col("name")).alias("name"), "entity")
    return rows.groupBy("name").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n")).filter("n = 1 AND length(name) >= 2").drop("n")


def interpretations(query: str, expansions: DataFrame, opposites: DataFrame) -> DataFrame:
    """(kind, rewritten): the query with an abbreviation spelled out, or with a word's opposite in its place."""
    text = F.lit(query)
    word = lambda c: F.concat(F.lit(r"(?i)\b\Q"), F.col(c), F.lit(r"\E\b"))
    a = expansions.filter(F.regexp_like(text, word("acronym"))).select(F.lit("expansion").alias("kind"), F.expr(f"regexp_replace({_quoted(query)}, concat('(?i)\\\\b\\\\Q', acronym, '\\\\E\\\\b'), phrase)").alias("rewritten"))
    b = opposites.filter(F.regexp_like(text, word("term"))).select(F.lit("opposite").alias("kind"), F.expr(f"regexp_replace({_quoted(query)}, concat('(?i)\\\\b\\\\Q', term, '\\\\E\\\\b'), opposite)").alias("rewritten"))
    return a.unionByName(b)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def categories(candidates: DataFrame, near: DataFrame) -> DataFrame:
    """Links (a, b) between candidates (id, name, parent) that share a name or a parent, and those of ``near``; each group by its first row."""
    links = [near.select("a", "b")]
    for key in ("name", "parent"):
        first = candidates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("a"))
        links.append(candidates.join(first, key).filter("id <> a").select("a", F.col("id").alias("b")))
    from functools import reduce

    return reduce(DataFrame.unionByName, links)
