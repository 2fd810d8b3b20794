import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corpusloom.llm import exact_dedup as ed
from corpusloom.llm import simhash as sh
from corpusloom.llm.common import documents
from corpusloom.llm.components import connected_components
from tests.conftest import SF


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_exact_dedup_matches_brute_force(spark, odd, which):
    docs = odd if which == "odd" else documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((-len(t or ""), d is None, d))
    keep = {k: min(v)[2] for k, v in groups.items()}
    want = Counter((d, keep[bare(t)], len(groups[bare(t)]), d == keep[bare(t)], hashlib.sha256(bare(t).encode()).hexdigest()) for d, t in rows)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.dedup(docs, ed.new_index(spark, 4)).collect())
    assert got == want


def test_a_later_batch_is_held_against_the_index(spark, tmp_path):
    one = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(4, "a  b"), (5, "d"), (6, "d ")], "doc_id long, text string")
    path = str(tmp_path / "index")
    index = ed.DigestIndex(spark, "index_of_test", path, buckets=4)
    assert {r.doc_id for r in ed.dedup(one, index).filter("kept").collect()} == {1, 3}
    got = {r.doc_id: (r.keep_id, r.kept) for r in ed.dedup(two, index).collect()}
    assert got == {4: (1, False), 5: (6, False), 6: (6, True)}
    assert index.table().count() == 3
    spark.sql("DROP TABLE index_of_test")
    again = ed.DigestIndex(spark, "index_of_test", path, buckets=4)
    assert not any(r.kept for r in ed.dedup(two.filter("doc_id = 5"), again).collect())
    spark.sql("DROP TABLE index_of_test")


def test_the_anti_join_reads_the_index_in_place(spark):
    index = ed.new_index(spark, 4)
    rows = ed.staged(ed.grouped(ed.digested(documents(spark, SF))), "t")
    index.append(rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.unseen(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    assert index.unseen(rows).count() == 0


def test_kept_documents_are_one_a_text(odd, none):
    kept = ed.kept_documents(odd)
    texts = [bare(r.text) for r in kept.collect()]
    assert {str(tuple(r)) for r in kept.collect()} <= {str(tuple(r)) for r in odd.collect()}
    assert kept.columns == odd.columns and len(texts) == len(set(texts))
    assert set(texts) == {bare(r.text) for r in odd.collect()}
    assert ed.kept_documents(none).count() == 0 and ed.dedup(none, ed.new_index(none.sparkSession, 2)).count() == 0


def plain_fingerprint(t, k):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < k else [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, values, distance):
    up = {v: v for v in set(values)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    vs = sorted(up)
    arr = np.array(vs, dtype=np.uint64)
    for i, v in enumerate(vs):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= distance):
            a, b = root(v), root(vs[i + 1 + j])
            up[max(a, b)] = min(a, b)
    least = {}
    for d, v in zip(ids, values, strict=True):
        if d is not None:
            least[root(v)] = min(least.get(root(v), d), d)
    return [least.get(root(v)) for v in values]


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_simhash_matches_brute_force(spark, odd, which):
    docs = odd if which == "odd" else documents(spark, SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    cache = {t: plain_fingerprint(t, 4) for t in {t for _, t in rows} if len(t or "") < 100_000}
    values = [cache.get(t, None) if t in cache else sh.fingerprint(t) for _, t in rows]
    comps = plain_components([d for d, _ in rows], values, 4)
    want = Counter((d, format(v, "016x"), c) for (d, _), v, c in zip(rows, values, comps, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in sh.near_duplicates(docs).collect()) == want


def test_long_texts_count_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(3000))
    whole = sh.fingerprint(text)
    monkeypatch.setattr(sh, "CHUNK", 100)
    assert sh.fingerprint(text) == whole == plain_fingerprint(text, 4)


@pytest.mark.parametrize("n", [10, 100_000, 20_000_000, 10**10])
def test_masks_cover_every_close_pair(n):
    rng = np.random.default_rng(3)
    masks = sh.block_masks(n, 4)
    for _ in range(300):
        flip = 0
        for b in rng.choice(64, 4, replace=False):
            flip |= 1 << int(b)
        assert any(not flip & m for m in masks)


def test_links_connect_dense_and_chained_groups(spark):
    rng = np.random.default_rng(5)
    values = []
    for _ in range(12):
        center = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(40):
            v = center
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                v ^= 1 << int(b)
            values.append(v)
        for _ in range(15):  # a chain
            for b in rng.choice(64, 4, replace=False):
                center ^= 1 << int(b)
            values.append(center)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for n in (10, 10**6, 10**9):
        edges = sh.links(spark.createDataFrame([(v, v) for v in signed], "fp long, node long"), n)
        labels = {r.node: r.label for r in connected_components(edges).collect()}
        mine = [labels.get(v, v) for v in signed]
        want = plain_components(list(range(len(values))), values, 4)
        pairs = set(zip(mine, want, strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_dense_groups_link_like_all_pairs(monkeypatch):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 1 << 63)) << 1
    values = sorted({base ^ sum(1 << int(b) for b in rng.choice(range(26), rng.integers(0, 9), replace=False)) for _ in range(900)})
    mask = ((1 << 64) - 1) ^ ((1 << 26) - 1)
    want = plain_components(list(range(len(values))), values, 4)
    monkeypatch.setattr(sh, "DENSE", 10)
    forest = sh.Forest()
    for a, b in sh.dense_links(np.array(values, np.uint64), mask, 4):
        assert (a ^ b).bit_count() <= 4
        forest.join(a, b)
    pairs = {(forest.root(v), w) for v, w in zip(values, want, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1


def test_rows_without_ids_name_no_component(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words stand here"), (5, "a b c d e f"), (-3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in sh.near_duplicates(docs).collect())
    assert got == Counter({(None, 5): 2, (None, None): 1, (5, 5): 1, (-3, -3): 1})
    assert sh.kept_documents(docs).count() == 5
    blind = docs.filter("doc_id is null")
    assert {r.component_id for r in sh.near_duplicates(blind).collect()} == {None} and sh.kept_documents(blind).count() == 3


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(500, 500)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100}


def test_near_copies_go_and_columns_stay(odd, none, spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, base), (2, base + " extra"), (3, "entirely different text about something else altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in sh.kept_documents(docs).collect()} == {1, 3}
    assert sh.kept_documents(odd).columns == odd.columns
    assert sh.near_duplicates(none).count() == 0 and sh.kept_documents(none).count() == 0
