"""What a dotted document number says: kind, parent, depth, and whether it is well formed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The endings that mark supporting documents, in the order in which they are tried, with the
# ending that leads to the parent.  Other numbers go by their count of segments.
ENDINGS = {
    "Scenario Variation": (r"\.var\d+$", r"\.var\d+$"),
    "Annotation": (r"\.0\.3\.\d+$", r"\.0\.3\.\d+$"),
    "Active Data": (r"\.0\.6\.\d+$", r"\.0\.6\.\d+$"),
    "Scenario": (r"\.0\.4\.\d+\.1\.\d+$", r"\.1\.\d+$"),
    "Action Tenet": (r"\.0\.4\.\d+$", r"\.0\.4\.\d+$"),
}
#: All supporting endings at the end of a number, one after the other.
TAIL = r"(?:\.0\.[36]\.\d+|\.0\.4\.\d+(?:\.1\.\d+(?:\.var\d+)?)?)+$"
RESEARCH = "Needed Research"
BY_SEGMENTS = {1: "Scope", 2: "Article", 3: "Section"}
OTHERWISE = "Core"
WELL_FORMED = {RESEARCH: r"^NR-\d+$", "Scope": r"^[A-Z]\.\d+$", "Article": r"^[A-Z](\.\d+){2}$", "Section": r"^[A-Z](\.\d+){3,}$", "Core": r"^[A-Z](\.\d+){4,}$"}


def dots(number: Column) -> Column:
    return F.size(F.split(number, r"\.")) - 1


def inferred_kind(number: Column) -> Column:
    out = F.when(number.startswith("NR-"), RESEARCH)
    for kind, (ending, _) in ENDINGS.items():
        out = out.when(number.rlike(ending), kind)
    for n, kind in BY_SEGMENTS.items():
        out = out.when(dots(number) == n, kind)
    return out.otherwise(OTHERWISE)


def parent_number(number: Column, kind: Column) -> Column:
    """Null for top numbers and for research, whose numbers say nothing of their place."""
    out = F.when(kind == RESEARCH, F.lit(None).cast("string"))
    for name, (_, ending) in ENDINGS.items():
        out = out.when(kind == name, F.when(number.rlike(ending), F.regexp_replace(number, ending, "")))
    return out.when(dots(number) > 1, F.regexp_replace(number, r"\.[^.]+$", ""))


def semantic_depth(number: Column, kind: Column) -> Column:
    """Dots of an ordinary number; a supporting document is one deeper than its parent, and so on up to an ordinary one.

    The supporting endings form a tail of the number: what stands before it gives the dots, and each ending
    in it a level.
    """
    tail = F.regexp_extract(number, TAIL, 0)
    levels = F.size(F.regexp_extract_all(tail, F.lit(r"\.0\.[346]\.\d+|\.1\.\d+|\.var\d+"), F.lit(0)))
    supporting = dots(F.regexp_replace(number, TAIL, "")) + levels
    return F.when(kind == RESEARCH, F.lit(None).cast("int")).when(kind.isin(list(ENDINGS)), supporting).otherwise(dots(number))


def heading_level(number: Column, kind: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(semantic_depth(number, kind), F.lit(6))))


def number_issues(docs: DataFrame) -> DataFrame:
    """(number, kind, issue): numbers of another form than their kind's, and numbers that are used twice."""
    form = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[0], F.col("number").rlike(kv[1])), [(k, e) for k, (e, _) in ENDINGS.items()] + list(WELL_FORMED.items()), F.when(F.lit(False), True))
    bad = docs.filter(~F.coalesce(form, F.lit(True))).select("number", "kind", F.lit("format").alias("issue"))
    twice = docs.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind")).filter("n > 1").select("number", "kind", F.lit("duplicate").alias("issue"))
    return bad.unionByName(twice)
