"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.col("v") % 1_000_003)).head())


def with_nodes(groups: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``node`` to ``groups`` (first: smallest doc_id, or null): that doc_id, or a number above all doc_ids of ``rows``.

    Also returns the least such number.  Components labelled by their smallest node are then labelled by their smallest doc_id.
    """
    most = rows.agg(F.max("doc_id")).head()[0]
    above = 0 if most is None else most + 1
    if above > 1 << 62:
        raise ValueError("doc_ids above 2**62 leave no numbers for rows without one")
    return groups.withColumn("node", F.coalesce("first", F.monotonically_increasing_id() + F.lit(above))), above


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v: long): label is the smallest node it is connected with.

    Each round joins a node's neighbours to their minimum, aggregated before the shuffle, so that a node
    with very many neighbours is no single task's work.  Rounds grow with the logarithm of the longest
    path; each is written to the shared folder, which cuts the lineage.
    """
    now = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = staged(now, "components")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
