"""What must not grow with the input: plans and batches of the operators, next to their results."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fulltext as ft
from corpusloom.operators import graph as gr
from corpusloom.operators import similarity as sim


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_spans_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "red widget ring small".split()), (2, []), (3, None), (4, "ring widget ring".split())], "id long, words array<string>").coalesce(1).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([("red widget", "RW"), ("widget", "W"), ("widget ring", "WR"), ("widget ring", "AR"), ("small", "S")], "alias string, entity string").coalesce(1).write.parquet(f"{tmp_path}/aliases")
    found = gr.longest_aliases(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/aliases"))
    assert {(r.id, r.entity) for r in found.collect()} == {(1, "RW"), (1, "S"), (4, "AR")}
    assert "Broadcast" not in plan(found)


def test_postings_are_made_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ft, "TERMS_AT_ONCE", 3)
    docs = spark.createDataFrame([(1, "A.1", "votes vote the v.1", 2), (2, " ", None, 0), (3, None, "licensing licensing", 5)], "id long, doc_no string, content string, depth int")
    found = ft.all_postings(docs)
    assert "Exchange" not in plan(found)
    assert {(r.term, r.field, r.id, r.depth, r.tf, r.len) for r in found.collect()} == {
        ("a.1", "doc_no", 1, 2, 1, 1), ("vote", "content", 1, 2, 2, 3), ("votes", "content", 1, 2, 1, 3), ("v.1", "content", 1, 2, 1, 3),
        ("licensing", "content", 3, 5, 2, 2), ("licens", "content", 3, 5, 2, 2),
    }


def test_cosines_are_held_against_thresholds_as_rounded(spark):
    v = [[1.0, 0.0], [0.3999996, (1 - 0.3999996**2) ** 0.5], [-1.0, 0.0], [0.0, 1.0]]
    rows = spark.createDataFrame([*enumerate(v), (9, None)], "id long, v array<double>")
    assert {(r.a, r.b, r.cosine) for r in sim.cosine_links(rows, (0.4,)).collect()} == {(0, 1, 0.4), (1, 3, 0.916515)}
    assert tuple(sim.cosine_counts(rows, (0.4, 0.5, 0.95)).head()) == (2, 1, 0)


def test_pairs_of_all_blocks_come_once(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(sim, "PAIR_BLOCK", 20)
    v = np.random.default_rng(4).normal(size=(300, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = [(r.a, r.b) for r in sim.cosine_links(rows, (0.7,)).collect()]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if round(float(v[i] @ v[j]), 6) >= 0.7}
    assert len(got) == len(want) and set(got) == want and sim.cosine_counts(rows, (0.7,)).head().t0 == len(want)
    assert sim.cosine_counts(rows.limit(0), (0.7,)).head().t0 == 0


@pytest.mark.parametrize("at_once", [1, 64, 1 << 20])
def test_a_task_keeps_k_rows_a_query(spark, monkeypatch, at_once):
    monkeypatch.setattr(sim, "SCORES_AT_ONCE", at_once)
    vs = {i: [float(i % 7), float(i % 3)] for i in range(200)}
    rows = spark.createDataFrame([*vs.items()], "id long, v array<double>").coalesce(1)
    asked = [0, 5, 300]
    queries = spark.createDataFrame([(i, vs.get(i, [1.0, -1.0])) for i in asked], "query_id long, q array<double>")
    monkeypatch.setattr(sim, "QUERY_BLOCK", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        found = {(r.query_id, r["rank"]): r.id for r in sim.vector_topk(rows, queries, 4).collect()}
        q = [vs[0], vs[5]]
        import numpy as np

        sent = spark.sparkContext.broadcast((np.array([0, 5], np.int64), np.array(q)))
        assert sim._block_candidates(rows, sent, 4).count() == 2 * 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    score = lambda i, q: sum(x * y for x, y in zip(vs[i], vs.get(q, [1.0, -1.0]), strict=True))
    for q_id in asked:
        want = sorted((i for i in vs if i != q_id), key=lambda i: (-score(i, q_id), i))[:4]
        assert [found[q_id, r] for r in range(1, 5)] == want


def test_word_forms_against_brute_force(spark):
    from corpusloom.functions import text as tx
    from corpusloom.plans import keyword_queries as kq
    from tests.conftest import SF

    docs = spark.createDataFrame([(1, "Licensing, licensed; licensing"), (2, "licence"), (3, ""), (4, None), (5, "off-licenses LICENSE v.1")], "id long, content string")
    assert {(r.id, r.forms) for r in ft.word_forms(docs, "licensing").collect()} == {(1, 2), (5, 2)}
    found = kq.QUERIES["stemmed_search"](spark, SF)
    assert "Exchange" not in plan(found)
    rows = kq.flat(spark, SF).select("id", tx.index_terms(F.col("content")).alias("t")).collect()
    counts = {r.id: len({t for t in r.t if tx.porter_stem(t) == "licens"}) for r in rows}
    assert {r.id: r.forms for r in found.collect()} == {i: n for i, n in counts.items() if n}


def test_co_mentions_are_counted_in_more_parts_where_pairs_are_more(spark, monkeypatch):
    monkeypatch.setattr(gr, "PAIRS_PER_TASK", 2)
    rows = [(s, e, 1) for s, es in {1: [1, 2, 3], 2: [3, 2, 2], 3: [2, 1, 3, 4], 4: [9], None: [1, 2]}.items() for e in es]
    found = gr.co_mentions(spark.createDataFrame(rows, "section long, entity long, count long"))
    assert {(r.a, r.b, r.n) for r in found.collect()} == {(1, 2, 2), (1, 3, 2), (2, 3, 3)}
    assert ", 5), REPARTITION_BY_NUM" in plan(found)


def test_equal_texts_are_not_matched_word_by_word(monkeypatch):
    import difflib

    from corpusloom.operators import versions as vs

    for words in ([], ["a"], "a b a b a".split()):
        want = difflib.SequenceMatcher(None, words, list(words), autojunk=False).get_opcodes()
        with monkeypatch.context() as m:
            m.setattr(difflib, "SequenceMatcher", None)
            assert vs._opcodes(words, list(words)) == want
    assert vs._opcodes(["a"], ["b"]) == [("replace", 0, 1, 0, 1)]
