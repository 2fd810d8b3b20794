"""Full-text search from a written index: words and stems in five fields, prefixes and typos weighed inside the ranking.

The index holds a row for each (term, field, document) with everything a score needs, so that a search joins
nothing but the few terms it asks for.  A hyphenated word is indexed as its parts and joined, a number whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators.keyword import DELTA, FIELD_BOOSTS, FUZZY_SHARE, FUZZY_WEIGHT, PREFIX_WEIGHT, RESULT_LIMIT, B, K, depth_boost
from corpusloom.staging import written

FIELDS = tuple(FIELD_BOOSTS)
#: Postings a bucket of the index, and documents of one term that a task writes: hot terms lie in several files.
POSTINGS_PER_BUCKET, PARTS = 4_000_000, 8
#: Terms of whole documents whose postings a Python worker makes at once, and asked terms that every task is sent.
TERMS_AT_ONCE, MOST_SENT = 1_000_000, 100_000
#: Fixed value: the most edits that a typo may have.
MOST_EDITS = 6


def terms_of(field: str) -> Column:
    """The index terms of a field in order, unstemmed; a document number is one term."""
    if field == "doc_no":
        whole = F.btrim(tx.fold(F.coalesce(F.col(field), F.lit(""))))
        return F.filter(F.array(whole), lambda t: t != "")
    return tx.index_terms(F.col(field))


def all_postings(docs: DataFrame) -> DataFrame:
    """(term, field, id, depth, tf, len) of documents with ids of their own: words, and the stems of those that differ from theirs.

    A document's postings are made from its row alone, nothing is shuffled: a batch's words become numbers, whose
    pairs with rows are counted, and stems are made once a distinct word of a batch.  ``len`` is the field's distinct terms.
    """
    fields = [f for f in FIELDS if f in docs.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms_of(f).alias("terms")) for f in fields])).alias("e")
    rows = docs.select("id", F.col("depth").cast("int").alias("depth"), each).select("id", "depth", "e.field", "e.terms")

    def work(batches):
        for b in batches:
            terms, start = b.column(3), 0
            ends = np.cumsum(pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TERMS_AT_ONCE, "right")))
                yield _counted(b.slice(start, stop - start))
                start = stop

    return rows.mapInArrow(work, f"term string, field string, id {docs.schema['id'].dataType.simpleString()}, depth int, tf long, len long")


def _counted(b: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of a batch (id, depth, field, terms)."""
    fields, terms = b.column(2), b.column(3)
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    numbers = {w: i for i, w in enumerate(words)}
    stems = np.array([numbers.setdefault(w if "." in w else tx.porter_stem(w), len(numbers)) for w in words], np.int64)
    width = max(1, len(numbers))
    pairs, tf = np.unique(np.repeat(np.arange(b.num_rows), sizes) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, word = np.divmod(pairs, width)
    other = (stems[word] != word) & pc.not_equal(fields, "doc_no").to_numpy(zero_copy_only=False)[row] if len(pairs) else np.zeros(0, bool)
    pairs, at = np.unique(np.concatenate([pairs, row[other] * width + stems[word[other]]]), return_inverse=True)
    tf = np.bincount(at, weights=np.concatenate([tf, tf[other]]), minlength=len(pairs)).astype(np.int64)
    row, word = np.divmod(pairs, width)
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(numbers), pa.string()).take(pa.array(word)), fields.take(rows), b.column(0).take(rows), b.column(1).take(rows), pa.array(tf), pa.array(np.bincount(row, minlength=b.num_rows)[row].astype(np.int64))],
        names=["term", "field", "id", "depth", "tf", "len"],
    )


def word_forms(docs: DataFrame, word: str) -> DataFrame:
    """(id, forms): of documents (id, content) the distinct terms with the stem of ``word``, in one pass and without a shuffle."""
    wanted = tx.porter_stem(word)

    def work(batches):
        for b in batches:
            coded = b.column(1).flatten().dictionary_encode()
            # A stem begins as its word does.
            same = np.array([w[:1] == wanted[:1] and tx.porter_stem(w) == wanted for w in coded.dictionary.to_pylist()], bool)
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), sizes)[same[coded.indices.to_numpy(zero_copy_only=False)]]
            forms = np.bincount(row, minlength=b.num_rows)
            found = np.flatnonzero(forms)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found)), pa.array(forms[found].astype(np.int64))], names=["id", "forms"])

    terms = F.array_distinct(tx.index_terms(F.col("content")))
    return docs.select("id", terms.alias("terms")).mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, forms long")


def write_index(docs: DataFrame, path: str) -> None:
    """The index of ``docs`` (id, depth and any of the fields) under ``path``: postings in buckets by term, terms, and statistics."""
    rows = written(all_postings(docs))
    buckets = max(1, -(-rows.count() // POSTINGS_PER_BUCKET))
    found = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    dealt = found.repartition(buckets * PARTS, "bucket", "_part").sortWithinPartitions("bucket", "term", "field", "id").drop("_part")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    rows.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    n = docs.count()
    # Each field's lengths sum up to its postings.
    stats = rows.groupBy("field").agg((F.count(F.lit(1)) / F.lit(max(1, n))).alias("avg"))
    stats.withColumn("n", F.lit(n)).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")


class Index:
    """A written index, opened for searches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings, self.terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
        self.stats = spark.read.parquet(f"{path}/stats")
        self.buckets = self.stats.agg(F.max("buckets")).head()[0] or 1

    def expanded(self, terms: Sequence[str], exact: bool = False) -> DataFrame:
        """(q, term, weight): the indexed terms that answer each query term, as themselves, as a prefix or as a typo.

        A prefix has two letters at least.  A typo is looked for only if the term is not indexed, has four letters
        and no dot; what is a longer word of the prefix is not also a typo of it.
        """
        words = self.terms.select("term")
        asked = F.explode(F.array(*[F.struct(F.lit(t).alias("q"), F.lit(min(MOST_EDITS, int(FUZZY_SHARE * len(t) + 0.5)) if len(t) >= 4 and "." not in t else 0).alias("edits")) for t in terms]))
        pairs = words.select("term", asked.alias("a")).select("term", "a.q", "a.edits")
        same, longer = F.col("term") == F.col("q"), F.length("term") - F.length("q")
        if exact:
            return pairs.filter(same).select("q", "term", F.lit(1.0).alias("weight")).distinct()
        prefix = F.col("term").startswith(F.col("q")) & (F.length("q") >= 2) & ~same
        distance = F.when((F.col("edits") > 0) & (F.abs(longer) <= F.col("edits")), F.levenshtein("term", "q"))
        weight = F.when(same, 1.0).when(prefix, PREFIX_WEIGHT * F.length("term") / (F.length("term") + 0.3 * longer)).when(distance <= F.col("edits"), FUZZY_WEIGHT * F.length("term") / (F.length("term") + distance))
        near = written(pairs.select("q", "term", weight.alias("weight"), same.alias("same"), (~same & ~prefix).alias("typo")).filter("weight IS NOT NULL").distinct())
        known = near.filter("same").select("q")
        return near.filter("NOT typo").unionByName(near.filter("typo").join(known, "q", "left_anti")).select("q", "term", "weight")

    def scored(self, terms: Sequence[str], fields: Sequence[str] = FIELDS, exact: bool = False, boosts: dict | None = None) -> DataFrame:
        """(id, score, matched) of the documents that answer a term.

        ``score`` sums weight * boost * ln(1 + (N - n + .5) / (n + .5)) * (delta + tf(k+1) / (tf + k(1 - b + b len/avg))) over
        answering terms and fields, times the matched query terms and the depth boost.
        """
        wanted = self.expanded(list(dict.fromkeys(terms)), exact)
        asked = written(wanted.join(self.terms.filter(F.col("field").isin(list(fields))), "term").join(F.broadcast(self.stats), "field"))  # a row a field
        # Few rows go to the postings, where they lie; those that very many terms answer are joined by sorting.
        asked = asked.hint("broadcast" if asked.count() <= MOST_SENT else "merge")
        hits = self.postings.filter(F.col("field").isin(list(fields)))
        if exact:
            numbers = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct()
            hits = hits.filter(F.col("bucket").isin([r.b for r in numbers.collect()]) & F.col("term").isin(list(terms)))
        rows = hits.join(asked, ["term", "field"])
        boost = F.create_map(*[x for k, v in (FIELD_BOOSTS | (boosts or {})).items() for x in (F.lit(k), F.lit(v))])[F.col("field")]
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = F.col("weight") * boost * idf * (DELTA + F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("len") / F.col("avg"))))
        each = rows.groupBy("id", "q").agg(F.sum(part).alias("s"), F.first("depth").alias("depth"))
        found = each.groupBy("id").agg(F.sum("s").alias("s"), F.count(F.lit(1)).cast("int").alias("matched"), F.first("depth").alias("depth"))
        return found.select("id", F.round(F.col("s") * F.col("matched") * depth_boost(F.col("depth")), 6).alias("score"), "matched")

    def search(self, query: str, limit: int = RESULT_LIMIT, fields: Sequence[str] = FIELDS, among: DataFrame | None = None) -> DataFrame:
        """(id, tier, score, rank): documents with every stemmed term; if they are fewer than ``limit``, below them those with any,
        and below those the ones that the unstemmed words find, which recovers typos.

        ``among`` (id) restricts the results, not the statistics.  A query of stop words alone finds nothing.
        """
        plain = tx.query_terms(query, trailing_prefix=True)
        stemmed = [tx.porter_stem(t) for t in plain]
        if not plain:
            return self.spark.createDataFrame([], "id long, tier int, score double, rank int")
        kept = lambda rows: rows if among is None else rows.join(among.select("id").distinct(), "id", "left_semi")
        first = written(kept(self.scored(stemmed, fields)))
        strict = first.withColumn("tier", F.when(F.col("matched") == len(set(stemmed)), 0).otherwise(1))
        passes = [strict]
        if plain != stemmed:
            more = kept(self.scored(plain, fields)).join(first.select("id"), "id", "left_anti")
            passes.append(more.withColumn("tier", F.lit(2)))
        # Each tier is cut before they meet, so that the windows see three times the limit.
        cut = [p.filter(F.col("tier") == t).orderBy(F.desc("score"), "id").limit(limit).select("id", "tier", "score") for p, ts in zip(passes, ((0, 1), (2,)), strict=False) for t in ts]
        both = reduce(DataFrame.unionByName, cut)
        full = F.sum((F.col("tier") == 0).cast("int")).over(Window.partitionBy(F.lit(0)))
        both = both.withColumn("_n", full).filter((F.col("tier") == 0) | (F.col("_n") < limit)).drop("_n")
        ranked = both.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "id")))
        return ranked.filter(F.col("rank") <= limit)

    def jump(self, number: str) -> DataFrame:
        """(id): the document whose whole number is ``number``, in either case."""
        return self.postings.filter((F.col("field") == "doc_no") & (F.col("term") == number.strip().lower())).select("id")
