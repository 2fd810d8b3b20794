"""Derived tables that are kept, pinned to a corpus, and made anew only where something changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPANSION = "paraphrase string, questions array<string>"
PROMPT_CAP = 4000


def write_pinned(df: DataFrame, path: str, corpus_hash: str) -> None:
    """Writes a derived table with the hash of the corpus it holds for; Spark's committer makes it appear whole."""
    df.withColumn("corpus_hash", F.lit(corpus_hash)).write.mode("overwrite").parquet(path)


def incremental(rows: DataFrame, store: DataFrame, make: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """(key, hash, version, value) of all ``rows`` (key, text): values of the store where text and version are the same, else made.

    ``make`` takes (key, hash, text) and adds ``value``; it is the seam for an embedding or another model.
    """
    wanted = rows.select("key", F.sha2("text", 256).alias("hash"), "text")
    have = store.filter(F.col("version") == version)
    kept = wanted.select("key", "hash").join(have, ["key", "hash"]).select("key", "hash", "version", "value")
    fresh = make(wanted.join(have.select("key", "hash"), ["key", "hash"], "left_anti"))
    return kept.unionByName(fresh.select("key", "hash", F.lit(version).alias("version"), "value"))


def parsed_expansions(answers: DataFrame) -> DataFrame:
    """(key, paraphrase, questions) of JSON answers (key, answer); broken ones, and empty ones, are left out."""
    body = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), EXPANSION)
    rows = answers.select("key", body.alias("x")).select("key", "x.paraphrase", F.filter("x.questions", lambda q: F.btrim(q) != "").alias("questions"))
    return rows.filter("paraphrase IS NOT NULL AND trim(paraphrase) <> ''")


def request_lines(rows: DataFrame, model: str) -> DataFrame:
    """One JSON request a row of (key, prompt), for a batch file."""
    body = F.struct(F.lit(model).alias("model"), F.left("prompt", F.lit(PROMPT_CAP)).alias("prompt"))
    return rows.select(F.to_json(F.struct(F.col("key").alias("custom_id"), body.alias("body"))).alias("value"))


def prompt_document(number: Column, name: Column, content: Column) -> Column:
    """A document as a prompt shows it, its text cut with a mark."""
    cut = F.when(F.length(content) > PROMPT_CAP, F.concat(F.left(content, F.lit(PROMPT_CAP)), F.lit("…"))).otherwise(content)
    return F.concat_ws("\n", F.concat(F.lit("["), number, F.lit("] "), name), cut)


def compared(before: DataFrame, after: DataFrame, metric: str) -> DataFrame:
    """(query, before, after, change) of queries in both reports; a query in one alone has a null change: drift."""
    b, a = before.select("query", F.col(metric).alias("before")), after.select("query", F.col(metric).alias("after"))
    return b.join(a, "query", "full_outer").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def shared_directions(vectors: DataFrame, components: int = 1, rounds: int = 100) -> tuple[list[float], list[list[float]]]:
    """Mean and leading directions of (id, v): sums and products are made in the executors, a dims x dims matrix comes back."""
    import numpy as np

    def moments(batches):
        import pyarrow as pa

        n, s, p = 0, None, None
        for b in batches:
            if b.num_rows:
                v = np.array(b.column(0).to_pylist(), np.float64)
                n, s, p = n + len(v), v.sum(0) + (0 if s is None else s), v.T @ v + (0 if p is None else p)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], names=["n", "s", "p"])

    parts = vectors.select("v").filter("v IS NOT NULL").mapInArrow(moments, "n long, s array<double>, p array<double>")
    # Partial sums of each task meet by place, not by row.
    total = parts.agg(F.sum("n")).head()[0]
    if not total:
        return [], []
    gather = lambda c: [r.x for r in parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]
    mean = np.array(gather("s")) / total
    d = len(mean)
    cov = np.array(gather("p")).reshape(d, d) / total - np.outer(mean, mean)
    out = []
    for _ in range(components):
        u = np.ones(d) / d**0.5
        for _ in range(rounds):
            w = cov @ u
            if np.linalg.norm(w) == 0:
                break
            u = w / np.linalg.norm(w)
        out.append(u.tolist())
        cov = cov - np.outer(u, u) * (u @ cov @ u)
    return mean.tolist(), out


def without_directions(vectors: DataFrame, mean: list[float], directions: list[list[float]]) -> DataFrame:
    """(id, v) less the mean and the parts along the directions, at length 1."""
    from corpusloom.operators.similarity import dot, norm

    v = F.zip_with("v", F.array(*[F.lit(m) for m in mean]), lambda x, m: x.cast("double") - m)
    rows = vectors.select("id", v.alias("v"))
    for u in directions:
        axis = F.array(*[F.lit(x) for x in u])
        rows = rows.withColumn("_d", dot(F.col("v"), axis)).select("id", F.zip_with("v", F.transform(axis, lambda x: x * F.col("_d")), lambda x, y: x - y).alias("v"))
    rows = rows.withColumn("_n", norm(F.col("v")))
    return rows.select("id", F.transform("v", lambda x: x / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n"))).alias("v"))
