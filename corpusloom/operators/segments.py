"""Grouping of search results by tree and likeness, and text excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, PROMOTION, DUPLICATE = 10, 60, 0.98


def tree_segments(candidates: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, rank, segment): the deepest ancestor (or the row itself) that at least two candidates share; else the row alone."""
    chains = candidates.select("id", "rank").join(closure, "id")
    shared = chains.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ancestor"))).filter("n >= 2")
    anchor = shared.groupBy("id").agg(F.min_by("ancestor", "distance").alias("segment"))
    return candidates.select("id", "rank").join(anchor, "id", "left").withColumn("segment", F.coalesce("segment", "id"))


def permuted(candidates: DataFrame, window: int = WINDOW, promotion: int = PROMOTION, duplicate: float = DUPLICATE) -> DataFrame:
    """(query, id, position): of (query, id, rank from 0, segment, v) each query's candidates with segments brought forward.

    Segments come in the order of their best rank.  One whose best is in the window emits its members there,
    less near copies of one it has emitted; one whose best is between the window and the promotion line
    emits its best.  Emitted window members come first in rank order, then the promoted, then all others.
    A query's candidates are a result page's, at most a few hundred.
    """

    def work(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("rank").reset_index(drop=True)
        vectors = [None if v is None else np.asarray(v, float) for v in pdf["v"]]

        def near(i, j):
            a, b = vectors[i], vectors[j]
            if a is None or b is None:
                return False
            size = np.linalg.norm(a) * np.linalg.norm(b)
            return size > 0 and a @ b / size >= duplicate

        inside, promoted = [], []
        for _, rows in sorted(pdf.groupby("segment").groups.items(), key=lambda g: min(g[1])):
            emitted: list[int] = []
            for i in sorted(rows):
                place = pdf["rank"][i]
                if place >= promotion or (place >= window and emitted):
                    break
                if place < window and any(near(i, j) for j in emitted):
                    continue
                emitted.append(i)
                (inside if place < window else promoted).append(i)
                if place >= window:
                    break
        first = sorted(inside) + promoted
        taken = set(first)
        order = first + [i for i in range(len(pdf)) if i not in taken]
        return pd.DataFrame({"query": pdf["query"].iloc[order].to_numpy(), "id": pdf["id"].iloc[order].to_numpy(), "position": range(len(order))})

    return candidates.groupBy("query").applyInPandas(work, "query long, id long, position long")


def group_summaries(rows: DataFrame) -> DataFrame:
    """(query, segment, first, hidden): each group's first row by position and the others it stands for."""
    entries = F.sort_array(F.collect_list(F.struct("position", "id")))
    out = rows.groupBy("query", "segment").agg(entries.alias("e")).filter(F.size("e") > 1)
    return out.select("query", "segment", F.col("e")[0]["id"].alias("first"), F.transform(F.slice("e", 2, F.size("e")), lambda x: x["id"]).alias("hidden"))


def excerpts(text: Column, terms: list[str], pad: int = 80, budget: int = 300) -> Column:
    """Windows of ``pad`` code points on either side of the terms' places, merged where they touch, to a budget in all."""
    from corpusloom.functions.text import fold

    folded = fold(text)
    places = F.array_sort(F.filter(F.array(*[F.instr(folded, t) for t in terms]), lambda p: p > 0))
    spans = F.transform(places, lambda p: F.struct(F.greatest(p - pad, F.lit(1)).alias("a"), F.least(p + pad, F.length(text)).alias("b")))
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        widened = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(acc) > 0) & (s["a"] <= F.try_element_at(acc, F.lit(-1))["b"] + 1), widened).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(spans, empty, lambda acc, s: step(acc, s))
    joined = F.array_join(F.transform(merged, lambda s: F.substring(text, s["a"], s["b"] - s["a"] + 1)), " … ")
    return F.left(F.when(F.size(places) > 0, joined).otherwise(F.left(text, F.lit(budget))), F.lit(budget))


def highlighted(text: Column, pattern: str) -> Column:
    """The text with matches of a pattern between marks."""
    return F.regexp_replace(text, f"({pattern})", "<mark>$1</mark>")
