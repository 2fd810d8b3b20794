"""Document fingerprints by order MinHash.

The k-mers of a text (runs of code points) are numbered by occurrence, so that repeats count.  For each
of several hash orders the smallest few numbered k-mers are chosen, put back into text order and hashed
as a tuple.  Two texts agree in an entry if they share the chosen k-mers and their order, which an edit
that moves or replaces text breaks where a set sketch would not notice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_schema, documents, range_buckets, ship, shuffle_partitions

K = 8
ENTRIES = 64
TUPLE = 2
#: k-mers hashed under all orders at a time: bounds memory and stays in the cache.
CHUNK = 2048


class Sketcher:
    """Fingerprints of texts; the hash orders follow from the seed alone."""

    def __init__(self, k: int = K, entries: int = ENTRIES, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.k, self.entries = k, entries
        # The k-mer hashes are mixed already; an odd factor modulo 2**32 gives each entry its own order of them.
        self.scale = rng.integers(0, 1 << 32, (entries, 1), dtype=np.uint32) | np.uint32(1)
        self.rows = np.arange(entries)
        self.buffer = np.empty((entries, CHUNK), np.uint32)

    def kmers(self, text: str):
        """(hash32, place) of the occurrence-numbered k-mers; a text shorter than k is one k-mer."""
        import numpy as np

        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        base, width = 0x9E3779B97F4A7C15, 1
        h = points + np.uint64(1)
        if len(points) < self.k:
            value = len(points)
            for p in points.tolist():
                value = (value * base + p + 1) % (1 << 64)
            h = np.array([value], np.uint64)
        else:
            power = base
            while 2 * width <= self.k:
                h = h[:-width] * np.uint64(power) + h[width:]
                power, width = power * power % (1 << 64), 2 * width
            for j in range(width, self.k):
                h = h[:-1] * np.uint64(base) + (points[j:] + np.uint64(1))
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        n = len(h)
        bits = np.uint64(max(1, (n - 1).bit_length()))
        order = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
        kind, place = order >> bits, (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        fresh = np.empty(n, bool)
        fresh[0] = True
        np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
        at = np.arange(n)
        number = at - np.maximum.accumulate(np.where(fresh, at, 0))
        # The number is part of the hash; the width of the place is not, so that texts of any length compare.
        mixed = (h[place] + number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) * np.uint64(0x9FB21C651E98DF25)
        return (mixed >> np.uint64(32)).astype(np.uint32), place

    def sketch(self, text: str):
        """The entries of a text as 32-bit numbers; the empty text's are all 0."""
        import numpy as np

        if not text:
            return np.zeros(self.entries, np.uint32)
        hashes, place = self.kmers(text)
        rows = self.rows
        top = np.uint32(0xFFFFFFFF)
        best = np.full((2, self.entries), top)
        who = np.zeros((2, self.entries), np.int64)
        for at in range(0, len(hashes), CHUNK):
            part = hashes[at : at + CHUNK]
            v = np.multiply(part, self.scale, out=self.buffer[:, : len(part)])
            i = v.argmin(axis=1)
            values = [v[rows, i]]
            places = [i + at]
            if v.shape[1] > 1:
                v[rows, i] = top
                j = v.argmin(axis=1)
                values.append(v[rows, j])
                places.append(j + at)
            all_v, all_i = np.concatenate([best, values]), np.concatenate([who, places])
            two = np.argsort(all_v, axis=0, kind="stable")[:2]
            best, who = np.take_along_axis(all_v, two, 0), np.take_along_axis(all_i, two, 0)
        if len(hashes) == 1:
            who[1] = who[0]
        swap = place[who[0]] > place[who[1]]
        first, second = np.where(swap, who[1], who[0]), np.where(swap, who[0], who[1])
        pair = hashes[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hashes[second].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def text_of(sketch) -> str:
    """The fingerprint's form in tables: 8 hex digits an entry."""
    return sketch.astype(">u4").tobytes().hex()


def likeness(a, b) -> float:
    """The share of entries in which two sketches agree."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much (or all) of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_sequence(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, lead, doc_id, text) in partitions that hold whole doc_id ranges in ascending order.

    One shuffle.  Each range starts with a copy of the last row below it (lead = true), and the first
    range with a copy of the very last row, so that every row finds its neighbour in its own partition.
    The ranges' ends are a row a range, a bounded number.
    """
    spark = docs.sparkSession
    placed = range_buckets(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", 4 * parts, "bucket")
    lowest = -(1 << 63)
    placed = placed.withColumn("order", F.coalesce("doc_id", F.lit(lowest)))
    ends = sorted((r.bucket, r.end) for r in placed.groupBy("bucket").agg(F.max("order").alias("end")).collect())
    heads = [(ends[i][1], ends[(i + 1) % len(ends)][0]) for i in range(len(ends))] or [(None, None)]
    heads = F.broadcast(spark.createDataFrame(heads, "order long, goes_to int"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lead"))
    copy = F.struct(F.col("goes_to").alias("bucket"), F.lit(True).alias("lead"))
    both = placed.join(heads, "order", "left").withColumn("at", F.explode(F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = both.select("at.bucket", "at.lead", "doc_id", "text", "order")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", F.desc("lead"), "order", "text").drop("order")


FINGERPRINT_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_pairs(docs: DataFrame, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and their likeness.

    Reads doc_id and text.  The next document is the one before in ascending doc_id order, the last one
    for the first; a single document is its own next.  Rows with the same doc_id follow each other by
    text, a null doc_id is the smallest.  A null text counts as empty: its fingerprint is all zeros.
    """
    ship(docs.sparkSession)
    target = arrow_schema(FINGERPRINT_SCHEMA)

    def work(batches):
        import pyarrow as pa

        sketcher = Sketcher(k, entries)
        last_text, last = "", sketcher.sketch("")
        for b in batches:
            out: list[list] = [[] for _ in target]
            for lead, doc_id, text in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                mine = last if text == last_text else sketcher.sketch(text)
                if not lead:
                    changed = edited(text, last_text)
                    other = mine if changed == text else sketcher.sketch(changed)
                    row = (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_of(mine), text_of(other), likeness(mine, other), likeness(mine, last))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                last_text, last = text, mine
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, target, strict=True)], schema=target)

    return in_sequence(docs, shuffle_partitions(docs.sparkSession)).mapInArrow(work, FINGERPRINT_SCHEMA)


def fingerprints(docs: DataFrame, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, fingerprint) of every whole text: a map, no shuffle."""
    from corpusloom.llm.common import arrow_batches

    ship(docs.sparkSession)
    schema = "doc_id long, fingerprint string"

    def work(doc_ids, texts):
        sketcher = Sketcher(k, entries)
        return doc_ids, [text_of(sketcher.sketch(t or "")) for t in texts]

    return docs.select("doc_id", "text").mapInArrow(arrow_batches(work, schema), schema)


def query(spark, sf_dir):
    return fingerprint_pairs(documents(spark, sf_dir))
