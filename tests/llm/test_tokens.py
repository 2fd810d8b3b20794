import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import byte_bpe as bb
from corpusloom.llm import token_files as tf
from corpusloom.llm.common import documents
from tests.conftest import SF


@given(st.lists(st.integers(0, 2**40), max_size=3000))
@settings(max_examples=40, deadline=None)
def test_codes_round_trip_and_random_access(ids):
    seg = tf.Segment(tf.pack(ids))
    assert seg.all().tolist() == ids and len(seg) == len(ids)
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert seg[i] == ids[i]


def test_rank_directory_over_many_blocks():
    ids = np.random.default_rng(1).choice([3, 300, 70_000], 20_000)
    seg = tf.Segment(tf.pack(ids))
    assert all(seg[i] == ids[i] for i in range(0, 20_000, 7))
    with pytest.raises(IndexError):
        seg[20_000]
    with pytest.raises(ValueError):
        tf.Segment(b"no segment")


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_token_files_match_the_library(spark, odd, tmp_path, which):
    docs = odd if which == "odd" else documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = sorted(((d if d is not None else -1), len(i), crc(i)) for (d, _), i in zip(rows, plain_ids([t for _, t in rows]), strict=True))
    tf.write(docs, str(tmp_path / "f"))
    got = sorted(tf.read(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_encode_like_texts(text):
    enc = ENCODER.setdefault("e", tf.WordEncoder(tf.default_tokenizer()))
    whole = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == whole


ENCODER: dict = {}


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tf.default_tokenizer()) as f:
        parts = json.load(f)
    parts["normalizer"] = None  # upper case stays
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(parts, f)
    text = "Hello World don't 12 STOP"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    got = tf.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).head()
    assert np.frombuffer(bytes(got.ids), "<u4").tolist() == [*want, 1]


def test_places_are_read_through_the_rank_directories():
    ids = np.random.default_rng(2).choice([3, 300, 70_000, 20_000_000], 9_000)
    seg = tf.Segment(tf.pack(ids))
    places = np.random.default_rng(3).integers(0, 9_000, 500)
    assert seg.at(places).tolist() == ids[places].tolist() and seg.at(np.zeros(0, np.int64)).tolist() == []


def test_small_segments_and_single_token(spark, tmp_path, monkeypatch):
    docs = documents(spark, SF)
    monkeypatch.setattr(tf, "SEGMENT_IDS", 500)
    tf.write(docs, str(tmp_path / "s"))
    segments = spark.read.parquet(str(tmp_path / "s"))
    row = segments.orderBy("bucket", "segment").first()
    assert tf.token_at(segments, row.bucket, row.first) == tf.Segment(bytes(row.codes))[0]
    assert tf.read(spark, str(tmp_path / "s")).count() == docs.count()


def test_empty_tables(none, spark, tmp_path):
    tf.write(none, str(tmp_path / "e"))
    assert tf.read(spark, str(tmp_path / "e")).count() == 0 and bb.encode(none).count() == 0


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_byte_bpe_matches_the_library(spark, odd, which):
    docs = odd if which == "odd" else documents(spark, SF)
    enc = bb.load_encoding(bb.default_ranks())
    for r in bb.encode(docs).collect():
        assert r.n_tokens == len(r.ids) and hashlib.sha256(enc.decode_bytes(list(r.ids))).hexdigest() == r.decoded_sha256
    want = sorted((str(r.doc_id), len(i := enc.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bb.encode(docs).collect()) == want


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", " \n"])
@pytest.mark.parametrize("text", ["{}x", "a{}", "{}", "a b{}\u00e9 c{} 1", "a{} "])
def test_long_runs_of_blanks_encode_like_short_ones(blank, text, monkeypatch):
    enc = bb.load_encoding(bb.default_ranks())
    short = text.format(*[blank * 30_000] * 2)
    want = enc.encode_ordinary(short)
    monkeypatch.setattr(bb, "PIECE", 1000)
    assert bb.encode_text(enc, short) == want


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_a_million_blanks(blank):
    enc = bb.load_encoding(bb.default_ranks())
    text = blank * 1_200_000 + "x"
    assert enc.decode_bytes(bb.encode_text(enc, text)) == text.encode()


@given(st.text(alphabet="ab '\n\t  é1!\x1c", max_size=300), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_safe_pieces_encode_like_the_whole(text, size):
    enc = bb.load_encoding(bb.default_ranks())
    pieces = bb.safe_pieces(text, size)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
