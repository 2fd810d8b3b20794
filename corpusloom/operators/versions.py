"""Comparing two versions of a corpus."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_body(body: Column) -> Column:
    """Hard spaces become spaces, and cross-references lose their document numbers."""
    plain = F.regexp_replace(body, " ", " ")
    return F.regexp_replace(plain, r"\[[A-Z]?[\d.]+ - ([^\]]+)\]", "[$1]")


def classified(base: DataFrame, head: DataFrame) -> DataFrame:
    """(id, status) of rows (id, number, name, body): new, modified, renumbered or removed; the unchanged are left out.

    A document of which only the number changed is unchanged; one whose references alone changed is renumbered.
    """
    b = base.select("id", *[F.col(c).alias(f"b_{c}") for c in ("number", "name", "body")], F.lit(True).alias("in_base"))
    joined = head.withColumn("in_head", F.lit(True)).join(b, "id", "full_outer")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"b_{c}"))
    status = (
        F.when(F.col("in_base").isNull(), "new").when(F.col("in_head").isNull(), "removed").when(same("body") & same("name"), F.lit(None))
        .when(same("name") & normalized_body(F.col("body")).eqNullSafe(normalized_body(F.col("b_body"))), "renumbered").otherwise("modified")
    )
    return joined.select("id", status.alias("status")).filter("status IS NOT NULL")


def stats(changes: DataFrame) -> DataFrame:
    kinds = ("new", "modified", "removed", "renumbered")
    return changes.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


def scope_roots(changes: DataFrame, closure: DataFrame) -> DataFrame:
    """Changed nodes without a changed ancestor."""
    above = closure.filter("distance > 0").join(changes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    return changes.select("id").join(above, "id", "left_anti")


def nearest_living(removed: DataFrame, closure: DataFrame, living: DataFrame) -> DataFrame:
    """(id, living): for each removed node the nearest ancestor that is still there."""
    up = closure.filter("distance > 0").join(removed.select("id"), "id", "left_semi").join(living.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return removed.select("id").join(up.groupBy("id").agg(F.min_by("ancestor", "distance").alias("living")), "id", "left")


def touched(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents (id, line_start, line_end) that a changed range (first, last) overlaps; ranges are one file's."""
    return docs.join(F.broadcast(ranges), (F.col("line_start") <= F.col("last")) & (F.col("first") <= F.col("line_end")), "left_semi").select("id")


def _opcodes(a: list[str], b: list[str]) -> list[tuple]:
    """The matcher's blocks; of equal texts the one that it finds too, but in the square of their repeated words."""
    if a == b:
        return [("equal", 0, len(a), 0, len(b))] if a else []
    return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def word_diff(pairs: DataFrame, absorb: int = 3) -> DataFrame:
    """(id, kept, removed, added, html) of (id, old, new): a word diff in which equal runs of up to ``absorb`` words between changes count as changed."""

    def work(batches):
        import html

        import pandas as pd

        for pdf in batches:
            out = []
            for key, old, new in zip(pdf["id"], pdf["old"], pdf["new"], strict=True):
                a, b = (old or "").split(), (new or "").split()
                blocks = _opcodes(a, b)
                merged: list[list] = []
                for i, (tag, a1, a2, b1, b2) in enumerate(blocks):
                    inner = 0 < i < len(blocks) - 1
                    same = tag == "equal" and not (inner and a2 - a1 <= absorb)
                    if merged and not same and not merged[-1][0]:
                        merged[-1][2], merged[-1][4] = a2, b2
                    else:
                        merged.append([same, a1, a2, b1, b2])
                kept = sum(m[2] - m[1] for m in merged if m[0])
                parts = []
                for same, a1, a2, b1, b2 in merged:
                    gone, come = html.escape(" ".join(a[a1:a2])), html.escape(" ".join(b[b1:b2]))
                    parts += [gone] if same else [f"<{t}>{x}</{t}>" for t, x in (("del", gone), ("ins", come)) if x]
                out.append((key, kept, len(a) - kept, len(b) - kept, " ".join(parts)))
            yield pd.DataFrame(out, columns=["id", "kept", "removed", "added", "html"])

    return pairs.select("id", "old", "new").mapInPandas(work, "id long, kept long, removed long, added long, html string")


def current_proposal(proposals: DataFrame) -> DataFrame:
    """The open proposal that was updated last, else the one merged last."""
    order = [F.when(F.col("state") == "open", 0).otherwise(1), F.desc(F.when(F.col("state") == "open", F.col("updated")).otherwise(F.col("merged"))), "id"]
    return proposals.filter((F.col("state") == "open") | F.col("merged").isNotNull()).orderBy(*order).limit(1)


def by_lag(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Rows whose ``value`` is below the one before them in ``order`` within their source."""
    before = F.lag(value).over(Window.partitionBy("source").orderBy(order))
    return rows.withColumn("before", before).filter(F.col("before") > F.col(value))


def grouped_scopes(roots: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(scope, root): several roots under one parent are shown as that parent, unless another parent's root lies under it too.

    A root alone under its parent, or without one, is its own scope.
    """
    placed = roots.select("id").join(nodes.select("id", "parent"), "id", "left")
    count = F.count(F.lit(1)).over(Window.partitionBy("parent"))
    placed = placed.withColumn("n", F.when(F.col("parent").isNotNull(), count).otherwise(1))
    parents = placed.filter("n > 1").select("parent").distinct()
    under = closure.filter("distance > 1").join(roots.select("id"), "id", "left_semi").select(F.col("ancestor").alias("parent")).distinct()
    lifted = parents.join(under, "parent", "left_anti").withColumn("lift", F.lit(True))
    rows = placed.join(lifted, "parent", "left")
    return rows.select(F.when(F.col("lift") & (F.col("n") > 1), F.col("parent")).otherwise(F.col("id")).alias("scope"), F.col("id").alias("root"))


def scope_labels(scopes: DataFrame, paths: DataFrame) -> DataFrame:
    """(scope, label): the shortest end of each scope's path (array of names, root first) that no other scope's path ends with."""
    rows = scopes.select(F.col("scope").alias("id")).distinct().join(paths, "id")
    ends = rows.select("id", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"), "path")
    ends = ends.select("id", "k", F.array_join(F.slice("path", F.size("path") - F.col("k") + 1, F.col("k")), " / ").alias("label"))
    alone = ends.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    best = alone.groupBy("id").agg(F.min_by("label", F.struct(F.when(F.col("n") == 1, 0).otherwise(1), "k")).alias("label"))
    return best.select(F.col("id").alias("scope"), "label")
