"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A map over the rows: no shuffle.  Long texts are split first, at places that no match of the pattern
spans, so that the library never sees more than a bounded piece of a text.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame

from corpusloom.llm.common import arrow_batches, documents, ship, worker_cache

#: Texts longer than this many code points are split.
PIECE = 200_000
# What the pattern's \\s stands for in the library (Unicode's White_Space), which Python's is not.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: No match of the pattern holds a blank after a non-blank: before such a space a text may be cut.
#: The left side is a non-blank for the library too, as Python counts more characters as blanks.
SAFE = re.compile(r"(?<=\S) ")
#: Runs of blanks that are cut out: the library's matcher recurses over each of a run, and overflows near a million.
LONG_RUN = re.compile(BLANK + "{20000,}")

SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(path: str):
    """The encoding of a rank file (base64 bytes and rank a line), once a worker."""

    def build():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("local_ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_cache(("byte_bpe", path), build)


def safe_pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` in pieces of about ``size`` code points; joined they are the text, encoded they are its ids.

    A run without a safe place stays whole, however long it is.
    """
    out, start = [], 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def encode_text(encoding, text: str) -> list[int]:
    if len(text) <= PIECE:
        return encoding.encode_ordinary(text)
    out, start = [], 0
    for run in LONG_RUN.finditer(text):
        # A run that a non-blank follows is one match but for its last blank, one at the end is one match whole.
        end = run.end() - (run.end() < len(text))
        for piece in safe_pieces(text[start : run.start()]):
            out += encoding.encode_ordinary(piece)
        out += encoding._encode_single_piece(text[run.start() : end])
        start = end
    for piece in safe_pieces(text[start:]):
        out += encoding.encode_ordinary(piece)
    return out


def decode_ids(encoding, ids: list[int]) -> bytes:
    """The raw bytes of the ids; any cut of a valid id list decodes, also within a character."""
    return encoding.decode_bytes(ids)


def encode(docs: DataFrame, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Reads doc_id and text.  Returns a row a document: doc_id, n_tokens, ids (null unless ``with_ids``),
    ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 (of the decoded bytes).  A null text
    counts as empty and has no tokens.  Runs of blanks may have any length.  Special-token strings are ordinary text.  Repeated rows give
    repeated rows, an empty table an empty result.
    """
    ship(docs.sparkSession)
    path = ranks or default_ranks()

    def work(doc_ids, texts):
        import numpy as np

        encoding = load_encoding(path)
        decimal = worker_cache(("byte_bpe_decimal", path), lambda: [str(i) for i in range(encoding.n_vocab)])
        n, kept, ids_sha, bytes_sha = [], [], [], []
        for text in texts:
            ids = encode_text(encoding, text or "")
            n.append(len(ids))
            kept.append(np.array(ids, np.int32) if with_ids else None)
            ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
            bytes_sha.append(hashlib.sha256(decode_ids(encoding, ids)).hexdigest())
        return doc_ids, n, kept, ids_sha, bytes_sha

    return docs.select("doc_id", "text").mapInArrow(arrow_batches(work, SCHEMA), SCHEMA)


def query(spark, sf_dir):
    return encode(documents(spark, sf_dir), with_ids=False).drop("ids")
