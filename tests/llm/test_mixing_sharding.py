import zlib
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import mixing, sharding
from corpusloom.llm.common import documents
from tests.conftest import SF


def size(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by sharing anew what is over until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_mix_meets_its_targets(spark, odd, which):
    docs = odd if which == "odd" else documents(spark, SF)
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, size(r.text)) for r in docs.collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-5)
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(docs.repartition(7)))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_small_share_cuts_within_one_epoch(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a") for i in range(100)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, share=0.5).collect()
    assert sum(r.taken for r in rows) == 500
    assert sum(r.taken == 10 for r in rows) == 50 and sum(r.copies for r in rows) == 50


def test_mixed_documents_keep_columns_and_repeat(spark, odd):
    docs = documents(spark, SF)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in out.collect()) == Counter(copies)
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_empty(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0 and sharding.interleave(none).count() == 0


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_shards_are_even_and_hold_the_mixture(spark, odd, which):
    docs = odd if which == "odd" else documents(spark, SF)
    rows = sharding.interleave(docs).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    n = len(rows)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(len(v) for v in slots.values()) <= {n // 16, n // 16 + 1} and set(slots) <= set(range(16))
    by = Counter((r.shard, r.source) for r in rows)
    for source, k in Counter(r.source for r in rows).items():
        for shard in slots:
            assert abs(by[shard, source] - k / 16) <= 2
    assert rows_of(sharding.interleave(docs)) == rows_of(sharding.interleave(docs.repartition(5)))


def test_rank_order_matches_brute_force(spark):
    import hashlib

    docs = documents(spark, SF)
    rows = docs.select("doc_id", "source").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append((hashlib.md5(f"shard:{r.doc_id}".encode()).hexdigest(), r.doc_id))
    place = []
    for k, s in enumerate(sorted(by)):
        for i, (_, d) in enumerate(sorted(by[s])):
            place.append(((2 * i + 1) / (2 * len(by[s])), k, d))
    order = [d for _, _, d in sorted(place)]
    got = sorted((r.shard, r.slot, r.doc_id) for r in sharding.interleave(docs).collect())
    assert [d for _, _, d in got] == order


def test_written_shards(spark, tmp_path):
    docs = documents(spark, SF)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_rows_are_written_once_with_all_columns(spark, odd, odd_rows, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*odd.columns, "shard_", "slot_"}
    assert Counter(tuple(map(str, r)) for r in back.select(odd.columns).collect()) == Counter(tuple(map(str, r)) for r in odd_rows)
    places = sorted((r.shard_, r.slot_) for r in back.collect())
    n = len(odd_rows)
    assert places == sorted((i * 3 // n, i - -(-(i * 3 // n) * n // 3)) for i in range(n))
    # Five rows, one doc_id twice and none twice.
    few = spark.createDataFrame([(1, "a", "s"), (1, "b", "s"), (None, "c", "s"), (None, "c", "s"), (2, None, None)], "doc_id long, text string, source string")
    sharding.write_shards(few, str(tmp_path / "few"), shards=2)
    assert spark.read.parquet(str(tmp_path / "few")).count() == 5


def test_clashing_columns_stay_as_they_are(odd, odd_rows):
    rows = Counter(tuple(map(str, r)) for r in mixing.mixed_documents(odd).collect())
    assert set(rows) <= {tuple(map(str, r)) for r in odd_rows}


@pytest.mark.parametrize("ids", ["null", "one"])
def test_hot_keys_are_dealt(spark, ids):
    n = 300
    docs = spark.createDataFrame([(None if ids == "null" else 7, f"t{i % 100} x", "s") for i in range(n)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, share=0.5).collect()
    assert len(rows) == n and sum(r.taken for r in rows) == n
    shards = Counter(r.shard for r in sharding.interleave(docs, 4).collect())
    assert shards == Counter({k: n // 4 for k in range(4)})
