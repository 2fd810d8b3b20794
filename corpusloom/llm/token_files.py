"""Token-ID files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first.  Level 0 has the first chunk of every id; a bitmap says
which ids go on, and level 1 has the second chunk of those alone, and so forth.  A rank directory over
each bitmap (set bits before every 64th byte) leads from an id's place on one level to its place on the
next, so that any token is read without decoding its neighbours.

A segment, all integers little-endian: b"DAC1", levels u32, ids u64; then a level: entries u64, the
chunks (a byte each), and, on all but the last level, the bitmap (bit i of byte i/8, zero-padded to whole
64-byte blocks) and the rank directory (u64 a block).

Segments are rows of a Parquet table with the doc_ids and token counts of the documents they hold, in
ascending doc_id order within a range of doc_ids.  Spark's writer commits them, so that a lost
executor or a store without local paths is no concern.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, arrow_schema, documents, range_buckets, new_place, ship, shuffle_partitions, worker_cache

MAGIC = b"DAC1"
BLOCK = 64
#: A segment is closed once it holds this many ids; a document is never divided.
SEGMENT_IDS = 1 << 20
#: Words whose ids a worker keeps; when full, the store starts anew.
KEPT_WORDS = 400_000
#: Words of letters that have one form each in Unicode.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: What the pre-tokenizer splits a word of those, digits and ASCII signs into, if it has no apostrophe.
PIECES = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")
#: How byte-level vocabularies write bytes: printable ones as themselves, the others in turn from U+0100.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
# The parts of a tokenizer file with which a text's ids are those of its words.
BY_WORD = {
    "truncation": None, "padding": None, "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
BY_WORD_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}
#: Appended to each document.
END_ID = 1

ENCODED = "doc_id long, n_tokens long, ids binary"
SEGMENT = "bucket int, segment int, first long, n_ids long, doc_ids array<long>, counts array<long>, codes binary"
DECODED = "doc_id long, bucket int, first long, n_tokens long, ids_crc32 long"


def pack(ids) -> bytes:
    """A segment of the ids (any unsigned integers below 2**64)."""
    import numpy as np

    rest = np.asarray(ids, dtype=np.uint64)
    levels = []
    while True:
        more = rest > 255
        chunk = (rest & np.uint64(255)).astype(np.uint8).tobytes()
        head = struct.pack("<Q", len(rest)) + chunk
        if not more.any():
            levels.append(head)
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % BLOCK, np.uint8)])
        counts = np.bitwise_count(bits).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts)[:-1].astype(np.uint64)])
        levels.append(head + bits.tobytes() + ranks.astype("<u8").tobytes())
        rest = rest[more] >> np.uint64(8)
    return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class Segment:
    """Random access to a packed segment; nothing is decoded before it is asked for."""

    def __init__(self, blob: bytes):
        import numpy as np

        if blob[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_levels, self.n = struct.unpack_from("<IQ", blob, 4)
        at, self.levels = 16, []
        for level in range(n_levels):
            (entries,) = struct.unpack_from("<Q", blob, at)
            chunks = np.frombuffer(blob, np.uint8, entries, at + 8)
            at += 8 + entries
            bits = ranks = None
            if level < n_levels - 1:
                blocks = -(-entries // (8 * BLOCK))
                bits = np.frombuffer(blob, np.uint8, blocks * BLOCK, at)
                ranks = np.frombuffer(blob, "<u8", blocks, at + blocks * BLOCK)
                at += blocks * (BLOCK + 8)
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at place i: a chunk and a rank on each of its levels."""
        import numpy as np

        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            shift += 8
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // (8 * BLOCK)
            before = int(np.bitwise_count(bits[block * BLOCK : i >> 3]).sum())
            before += (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + before
        return value

    def at(self, places):
        """The ids at many places, each found as by ``[]``, a level at a time for all of them."""
        import numpy as np

        i = np.asarray(places, dtype=np.int64)
        out, on = np.zeros(len(i), np.uint64), np.arange(len(i))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[on] |= chunks[i].astype(np.uint64) << np.uint64(8 * level)
            if bits is None:
                break
            more = (bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1
            on, i = on[more], i[more]
            block = i // (8 * BLOCK)
            # Set bits of the block's bytes before the byte, and of the byte below the bit.
            within = bits.reshape(-1, BLOCK)[block] * (np.arange(BLOCK) < ((i >> 3) % BLOCK)[:, None])
            below = bits[i >> 3] & ((1 << (i & 7)) - 1).astype(np.uint8)
            i = ranks[block].astype(np.int64) + np.bitwise_count(within).sum(axis=1, dtype=np.int64) + np.bitwise_count(below)
        return out

    def all(self):
        """Every id, level by level."""
        import numpy as np

        out, where = np.zeros(self.n, np.uint64), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks.astype(np.uint64) << np.uint64(8 * level)
            if where is None:
                out |= part
                where = np.arange(self.n)
            else:
                out[where] |= part
            if bits is not None:
                where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of a text by the tokenizers library, each distinct word encoded once.

    The file's pre-tokenizer drops white space and its normalizer works within words, so that a text's ids
    are its words' ids in order, and those of a word are its pieces' ids.  Words are split at ASCII blanks.
    Texts that hold an added token, in any case of letters, go through the library whole, as do all texts
    with a file whose parts are not those that this is true of.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        model = {k: v for k, v in parts["model"].items() if k not in ("vocab", "merges")}
        self.by_word = all(parts.get(k) == v for k, v in BY_WORD.items()) and model == BY_WORD_MODEL
        self.model = self.tokenizer.model

    def _ids(self, text: bytes) -> bytes:
        import numpy as np

        return np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if LATIN.fullmatch(text):
            # One piece for the pre-tokenizer, and lowering is all that the normalizer does: on to the merges.
            piece = text.lower().encode().decode("latin-1").translate(BYTE_SIGNS)
            return struct.pack(f"<{len(t := self.model.tokenize(piece))}I", *[x.id for x in t])
        pieces = PIECES.findall(text)
        if len(pieces) < 2 or "'" in text or "".join(pieces) != text:
            return self._ids(word)
        known, out = self.words, []
        for p in pieces:
            key = p.encode()
            if key not in known:
                known[key] = self._word(key)
            out.append(known[key])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        raw = text.encode()
        if not self.by_word:
            return self._ids(raw)
        low = raw.lower()
        if any(t in low for t in self.added):
            return self._ids(raw)
        words = low.split()
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words
        for w in set(words).difference(known):
            known[w] = self._word(w)
        return b"".join([known[w] for w in words])


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text, ``end_id`` appended; null counts as empty.  A map, no shuffle."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)

    def work(doc_ids, texts):
        encoder = worker_cache(("word_encoder", path), lambda: WordEncoder(path))
        ids = [encoder.encode(t or "") + end for t in texts]
        return doc_ids, [len(i) // 4 for i in ids], ids

    return docs.select("doc_id", "text").mapInArrow(arrow_batches(work, ENCODED), ENCODED)


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the token segments of ``docs`` (doc_id and text are read) to ``path``.

    Each range of doc_ids is one sorted run of segments; rows with the same doc_id follow each other, a null
    doc_id comes first.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ranges = range_buckets(docs.select("doc_id", "text"), "doc_id", 4 * parts, "bucket")
    with_range = ranges.select("doc_id", "text", "bucket")
    ship(spark)
    file = tokenizer or default_tokenizer()
    end = struct.pack("<I", END_ID)
    # 16-bit ids go through the shuffle as such.
    narrow = "doc_id long, bucket int, wide boolean, ids binary"

    def encode_rows(doc_ids, texts, buckets):
        import numpy as np

        encoder = worker_cache(("word_encoder", file), lambda: WordEncoder(file))
        wide, out = [], []
        for t in texts:
            ids = np.frombuffer(encoder.encode(t or "") + end, "<u4")
            big = bool(ids.max() > 0xFFFF)
            wide.append(big)
            out.append(ids.tobytes() if big else ids.astype("<u2").tobytes())
        return doc_ids, buckets, wide, out

    rows = with_range.mapInArrow(arrow_batches(encode_rows, narrow), narrow)
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")

    target = arrow_schema(SEGMENT)

    def build(batches):
        import numpy as np
        import pyarrow as pa

        bucket, segment, first, held, ids, n = None, 0, 0, [], [], 0

        def closed():
            row = [[bucket], [segment], [first], [n], [[d for d, _ in held]], [[c for _, c in held]], [pack(np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, target, strict=True)], schema=target)

        for b in batches:
            for doc_id, at, wide, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (at != bucket or n >= SEGMENT_IDS):
                    yield closed()
                    segment, first = (segment + 1, first + n) if at == bucket else (0, 0)
                    held, ids, n = [], [], 0
                bucket = at
                ids.append(np.frombuffer(raw, "<u4" if wide else "<u2"))
                held.append((doc_id, len(ids[-1])))
                n += len(ids[-1])
        if held:
            yield closed()

    # Not compressed: a code is read where it lies.
    dealt.mapInArrow(build, SEGMENT).write.mode("overwrite").option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Decodes the segments under ``path``: a row a document with its place in the whole and a checksum of its ids.

    Returns doc_id, start (ids before it), n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers).
    """
    ship(spark)
    segments = spark.read.schema(SEGMENT).parquet(path)

    def work(buckets, firsts, doc_ids, counts, codes):
        import numpy as np

        out = [[], [], [], [], []]
        for bucket, first, docs, sizes, blob in zip(buckets, firsts, doc_ids, counts, codes, strict=True):
            packed = Segment(blob)
            ids, at = packed.all().astype("<u4"), 0
            # Each document's last id once more, by the rank directories alone.
            ends = np.cumsum(sizes) - 1
            if not np.array_equal(packed.at(ends), ids[ends]):
                raise ValueError("a segment's rank directories contradict its codes")
            for doc, size in zip(docs, sizes, strict=True):
                for column, v in zip(out, (doc, bucket, first + at, size, zlib.crc32(ids[at : at + size])), strict=True):
                    column.append(v)
                at += size
        return out

    # A row a range, a bounded number: one ordered task adds them up.
    totals = segments.groupBy("bucket").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    decoded = segments.select("bucket", "first", "doc_ids", "counts", "codes").mapInArrow(arrow_batches(work, DECODED), DECODED)
    return decoded.join(offsets, "bucket").select("doc_id", (F.col("first") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")


def token_at(segments: DataFrame, bucket: int, place: int) -> int:
    """The id at ``place`` of a range: reads one segment and touches a chunk a level."""
    row = segments.filter((F.col("bucket") == bucket) & (F.col("first") <= place) & (F.col("first") + F.col("n_ids") > place)).select("first", "codes").head()
    if row is None:
        raise IndexError(place)
    return Segment(bytes(row.codes))[place - row.first]


def query(spark, sf_dir):
    path = new_place(spark, "token-files")
    write(documents(spark, sf_dir), path)
    return read(spark, path)
