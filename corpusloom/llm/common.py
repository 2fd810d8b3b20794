"""What the operators of this subpackage share: staging, worker caches, distributed prefix sums."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.shipping import ship  # noqa: F401  for the operators
from corpusloom.staging import new_place, written

#: One "word": a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per bucket of a distributed ordering, and the most buckets of one group.
ROWS_PER_BUCKET = 2048
MOST_BUCKETS = 1 << 20
#: Rows that a Python worker holds as Python objects.
ROWS_AT_ONCE = 256


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage without executor-local storage: a lost executor costs only its running tasks.
    """
    return written(df, name)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hashed_side(keys: DataFrame, rows: int) -> DataFrame:
    """``keys`` as the hashed side of a join, so that the other side is dealt but not sorted, if a task's share is small.

    Beyond a million rows a task the join sorts both sides, which spills.
    """
    return keys.hint("shuffle_hash" if rows <= 1_000_000 * shuffle_partitions(keys.sparkSession) else "merge")


def worker_cache(key, build):
    """``build()`` once a worker process (tokenizers, model matrices), however many tasks it runs."""
    store = sys.__dict__.setdefault("_corpusloom_cache", {})
    if key not in store:
        store[key] = build()
    return store[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def blind_digest(doc_id: str, text: str) -> Column:
    """``_digest``: the MD5 of the texts of rows without an id, null for all others."""
    return F.when(F.col(doc_id).isNull(), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("_digest")


def shuffle_key(doc_id: Column, seed: str, digest: Column | None = None) -> Column:
    """A seeded hash that orders rows at random, the same in every run (hex, 32 digits).

    Rows without an id have ``digest`` in its place, if it is given, so that they do not all share one key.
    """
    blind = F.lit("") if digest is None else F.concat(F.lit(":"), digest)
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), blind)))


def unit(key: Column) -> Column:
    """The place of a hex key in [0, 1): its first 48 bits; rises with the key."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def buckets_for(rows: Column) -> Column:
    return F.least(F.ceil(rows / F.lit(ROWS_PER_BUCKET)), F.lit(MOST_BUCKETS)).cast("long")


def prefix_sums(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group that stand before this row.

    ``bucket`` must rise with ``order``.  Each (group, bucket) is summed on its own, the bucket totals
    are accumulated, and only then is each bucket ordered, so that no task holds a whole group.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    offsets = totals.select(*group, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(offsets, [*group, bucket])
        .withColumn(out, F.col("_offset") + F.col("_within"))
        .drop("_offset", "_within")
    )


def ranked_sources(stats: DataFrame) -> DataFrame:
    """Numbers the rows of a one-row-a-source table from 0, by code point, null last.

    The table has a row a source, not a document, so that one ordered task is enough.
    """
    return stats.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def range_buckets(df: DataFrame, column: str, buckets: int, out: str) -> DataFrame:
    """Adds ``out``: the number of a range of ``column`` (long), of about ``buckets`` ranges of like many rows.

    The bounds are approximate quantiles of that column alone (the scan reads no other), ``buckets`` of
    them at most; a null goes to the first range.  Each row finds its range by binary search in the JVM.
    """
    from pyspark.ml.feature import Bucketizer

    place = F.coalesce(F.col(column).cast("double"), F.lit(-1e308))
    found = df.select(F.percentile_approx(place, [i / buckets for i in range(1, buckets)], 100 * buckets)).head()[0] if buckets > 1 else None
    bounds = sorted({b for b in found or [] if b > -1e308})
    placed = df.withColumn("_place", place)
    if not bounds:
        return placed.withColumn(out, F.lit(0)).drop("_place")
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_place", outputCol="_range")
    return cut.transform(placed).withColumn(out, F.col("_range").cast("int")).drop("_place", "_range")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_schema(schema: str):
    """The Arrow schema of a DDL string; on the driver only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def arrow_batches(fn, schema: str):
    """A mapInArrow function from ``fn(lists) -> lists``: Python lists of the input columns in, of the output's out.

    A few rows become Python objects at a time, however many a batch holds.
    """
    target = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                out = fn(*[c.to_pylist() for c in b.slice(at, ROWS_AT_ONCE).columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, target, strict=True)], schema=target)

    return run
