"""Exact dedup by a persistent digest index, on DataFrame functions alone.

The index is a table bucketed and sorted by digest.  New data is first reduced to one row a digest
(partial aggregation, so a hot group never meets in one task), then kept apart from the index by a
sort-merge anti-join that reads the index in place, and its survivors are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, shuffle_partitions, staged, unused

#: Digests a bucket of a new index: about 200 MB.
DIGESTS_PER_BUCKET = 2_000_000
#: The characters that do not count: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without blanks; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


class DigestIndex:
    """Digest -> the document that stays, in a table of ``buckets`` buckets sorted by digest.

    ``name`` is a table of the session's catalog, ``path`` an optional place outside the warehouse (an
    index written there earlier is opened again).  The bucket count is a property of the index: choose
    it for its final size, about 200 MB a bucket.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            place = f" LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {name} (text_sha256 STRING, keep_id BIGINT, n_points BIGINT) USING parquet "
                f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS{place}"
            )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """The rows of ``digests`` (one row a digest) that the index lacks; only the new side is shuffled."""
        return digests.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, digests: DataFrame) -> None:
        """Adds rows (text_sha256, keep_id, n_points) in the index's layout, one file a bucket."""
        rows = digests.select("text_sha256", "keep_id", "n_points").repartition(self.buckets, "text_sha256")
        rows.write.format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").saveAsTable(
            self.name, **({"path": self.path} if self.path else {})
        )


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, text_sha256) of every row, staged: the texts are read and hashed once."""
    rows = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"), text_digest(F.col("text")).alias("text_sha256"))
    return staged(rows, "exact-digests")


def grouped(digests: DataFrame) -> DataFrame:
    """One row a digest: the row that stays (most code points, then the smallest doc_id) and the group's size."""
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"))).alias("best")
    g = digests.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size"))
    real = F.when(F.col("best.id") == (1 << 63) - 1, F.lit(None)).otherwise(F.col("best.id"))
    return g.select("text_sha256", real.cast("long").alias("keep_id"), (-F.col("best.less")).alias("n_points"), "group_size")


def dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Deduplicates a batch against ``index`` (none: a new one, of as many buckets as the digests need) and within itself.

    Appends what is new to the index.

    Reads the columns doc_id and text.  Returns a row a document: doc_id, keep_id (of the row that stays, which
    may have come in an earlier batch), group_size (rows of the batch with that text), kept, text_sha256.
    A null text counts as empty; a null doc_id is the last choice to stay.  Of rows with the same doc_id and
    text one is not told from the other: both have kept = true if that id stays.  Empty in, empty out.
    """
    rows = digested(docs)
    groups = staged(grouped(rows), "exact-groups")
    index = index or new_index(docs.sparkSession, buckets_for_digests(groups))
    index.append(index.unseen(groups))
    known = index.table().select("text_sha256", "keep_id").hint("merge")
    placed = staged(groups.select("text_sha256", "group_size").join(known, "text_sha256"), "exact-placed")
    # A hot digest has one row on the right, and adaptive execution splits its rows on the left: both sides
    # are dealt by the join's own exchanges, which a bucketed scan on the right would prevent.
    return rows.join(placed, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def buckets_for_digests(digests: DataFrame) -> int:
    """As many buckets as shuffle partitions, so that either side of the join is dealt alike, or more for more digests."""
    return max(shuffle_partitions(digests.sparkSession), -(-digests.count() // DIGESTS_PER_BUCKET))


def new_index(spark: SparkSession, buckets: int) -> DigestIndex:
    """An empty index of its own name, in the warehouse; ``drop`` it when its results are used up."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets=buckets)


def kept_documents(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with the columns of ``docs``; of rows alike in doc_id and text one stays.

    Only the doc_ids of rows that go, and of rows that share a doc_id, take part in joins with the texts.
    Columns of any name are kept as they are.
    """
    decided = dedup(docs, index)
    by_id = decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    odd = staged(by_id.filter(~F.col("kept") | (F.col("n") > 1)).withColumnRenamed("doc_id", "_id"), "exact-odd")
    plain = docs.join(odd.select("_id"), docs["doc_id"].eqNullSafe(odd["_id"]), "left_anti")
    shared = odd.filter("n > 1 AND kept").select("_id")
    own = unused(docs, "_own_sha")
    several = docs.withColumn(own, text_digest(F.col("text"))).join(shared, docs["doc_id"].eqNullSafe(shared["_id"]), "left_semi")
    stays = decided.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    several = several.join(stays, several["doc_id"].eqNullSafe(stays["_id"]) & (several[own] == stays["_sha"]), "left_semi")
    return plain.unionByName(several.dropDuplicates(["doc_id", own]).select(*docs.columns))


def query(spark, sf_dir):
    # One batch: which row of a text stays is chosen among all rows of the table, not among those of a part.
    return dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
