"""Sharding by proportional stratified interleaving.

Within each source the rows get ranks in the order of a seeded hash; (rank - 1/2) / rows of the source
spreads each source evenly over [0, 1).  Sorted by that fraction, any run of rows holds the sources in
the mixture's proportions, so that equal cuts of the sorted rows are the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import blind_digest, buckets_for, documents, prefix_sums, ranked_sources, shuffle_key, shuffle_partitions, staged, unit, unused

#: Consecutive slots of a shard that one task writes.
ROWS_PER_FILE = 250_000


def interleave(docs: DataFrame, shards: int = 16, seed: str = "shard", row: str | None = None) -> DataFrame:
    """The shard and slot of each row: law `rows`, whose counts are at most one apart.

    Reads doc_id, text and source.  Returns doc_id, source, size (UTF-8 bytes of the text and 1; a null text has
    none), text_crc32, law, shard, slot and grown_shard (null: another shard count deals all rows anew).  Rows
    with the same doc_id are dealt as separate rows; a null source is a source of its own, a null doc_id is drawn by
    its text.  Rows alike in doc_id, text and source are ranked as one and told apart afterwards.  The method places
    single rows, so that copies of a text may lie in different shards.  Empty in, empty out.  ``row`` names a
    column that numbers the rows of ``docs``; it is returned too.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    told = [F.col(row).alias("_row")] if row else []
    seen = docs.select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), blind_digest("doc_id", "text"), *told)
    seen = staged(seen, "shard-rows")
    stats = ranked_sources(seen.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))).withColumnRenamed("source", "_source")
    total = seen.count()
    rows = seen.groupBy("doc_id", "source", "size", "text_crc32", "_digest", *(["_row"] if row else [])).agg(F.count(F.lit(1)).alias("_alike"))
    rows = rows.join(stats, rows["source"].eqNullSafe(stats["_source"])).drop("_source")
    rows = rows.withColumn("_key", shuffle_key(F.col("doc_id"), seed, F.col("_digest"))).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_bucket", F.floor(unit(F.col("_key")) * buckets_for(F.col("_rows"))))
    rows = prefix_sums(rows, ["_rank"], "_bucket", ["_key", "doc_id", "text_crc32", "size", *(["_row"] if row else [])], "_alike", "_place").drop("_bucket")
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0), F.col("_alike") - 1))).withColumn("_place", F.col("_place") + F.col("_nth"))
    rows = rows.withColumn("_fraction", (2 * F.col("_place") + 1).cast("double") / (2 * F.col("_rows")).cast("double"))
    # The fractions are even over [0, 1) whatever the sources' sizes, and so are these buckets.
    rows = rows.withColumn("_all", F.lit(0)).withColumn("_slice", F.floor(F.col("_fraction") * buckets_for(F.lit(total))))
    rows = prefix_sums(rows, ["_all"], "_slice", ["_fraction", "_rank"], "_one", "_position")
    shard = F.expr(f"_position * {shards} div {max(total, 1)}")
    rows = rows.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return rows.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_position") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *([F.col("_row").alias(row)] if row else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: str = "shard") -> None:
    """Writes the documents to ``path``/shard=N/, each shard in files of consecutive slots, in slot order.

    Every row is written once, whatever rows share its doc_id: the rows are numbered and staged first, and find
    their places by that number.  The columns of ``docs`` stay; where it has a shard or slot of its own, the new
    columns are called shard_ or slot_ instead (and so forth).
    """
    row, shard, slot, file = (unused(docs, n) for n in ("_row", "shard", "slot", "_file"))
    # Written, so that a row has the same number whenever it is read.
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "shard-documents")
    places = interleave(numbered, shards, seed, row).select(F.col(row).alias("_place"), F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed = numbered.join(places, numbered[row] == places["_place"]).drop(places["_place"]).drop(row)
    placed = placed.withColumn(file, F.floor(F.col(slot) / ROWS_PER_FILE))
    parts = max(shuffle_partitions(docs.sparkSession), shards)
    dealt = placed.repartition(parts, shard, file).sortWithinPartitions(shard, slot).drop(file)
    dealt.write.partitionBy(shard).mode("overwrite").parquet(path)


def query(spark, sf_dir):
    return interleave(documents(spark, sf_dir)).drop("source")


# CRC-32 by its table, a byte a step; the rest is plain window functions.
SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
raw AS (SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1) AS bytes, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS digest FROM documents),
rows AS (SELECT doc_id, source, digest, CAST(len(bytes) + 1 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM raw, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id IS NULL THEN md5('shard::' || digest) ELSE md5('shard:' || CAST(doc_id AS VARCHAR)) END, doc_id, text_crc32, size) - 1 AS place,
  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS LAST) AS rank, count(*) OVER () AS total FROM rows),
ordered AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * place + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), rank) - 1 AS position FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position * 16 // total AS INTEGER) AS shard,
  CAST(position - (position * 16 // total * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM ordered
"""
