import io
import tarfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as ev
from corpusloom.operators import graph as gr
from corpusloom.operators import quality as qa
from corpusloom.operators import similarity as sim
from corpusloom.operators import tree as tr
from corpusloom.operators import versions as vs
from corpusloom.sources import markdown as md
from corpusloom.streaming import stateful as st

U = "00000000-0000-0000-0000-0000000000{:02d}"
ATOMS = {  # folder: (n, number, name, kind, targets, body)
    "A/0": (1, "A.0", "Start", "Scope", "", "Top."), "A/0/2": (2, "A.0.2", "'It''s two'", "Article", "", "Second."), "A/0/10": (3, "A.0.10", "Ten", "Article", "", "Tenth.\n\nMore."),
    "A/0/2/1/5": (4, "A.0.2.1.5", "Deep", "Core", "", "Skips a level."), "NR/1": (5, "NR-1", "Open", "Needed Research", f"[{U.format(2)}]", "Why?"),
}


def atom(n, number, name, kind, targets, body):
    aim = f"targets: {targets}\n" if targets else ""
    return f"---\nid: {U.format(n)}\ndocNo: {number}\nname: {name}\ntype: {kind}\ndepth: 1\nchildType: x\n{aim}---\n\n# {number} - heading\n\n{body}\n"


@pytest.fixture
def atoms(tmp_path):
    for folder, doc in ATOMS.items():
        (tmp_path / "atoms" / folder).mkdir(parents=True)
        (tmp_path / "atoms" / folder / "document.md").write_text(atom(*doc))
    return str(tmp_path / "atoms")


def test_atoms_compose_and_read_back(spark, atoms, tmp_path):
    docs = md.load(spark, atoms)
    rows = {r.number: r for r in docs.collect()}
    assert rows["A.0.2"].name == "It's two" and rows["A.0.10"].body == "Tenth.\n\nMore." and rows["NR-1"].targets == [U.format(2)]
    whole = md.composed(docs).orderBy("position").collect()
    assert [r.number for r in whole] == ["A.0", "A.0.2", "NR-1", "A.0.2.1.5", "A.0.10"]
    assert {r.number: r.level for r in whole} == {"A.0": 1, "A.0.2": 2, "NR-1": 3, "A.0.2.1.5": 3, "A.0.10": 2}
    (tmp_path / "buckets").mkdir()
    (tmp_path / "buckets" / "A.0 - Start.md").write_text("\n".join(r.text for r in whole))
    again = md.load(spark, str(tmp_path / "buckets"))
    key = lambda d: sorted((r.uuid, r.number, r.name, r.kind, r.body) for r in d.collect())
    assert key(again) == key(docs) and md.corpus_hash(again, ["uuid", "number", "name", "kind", "body"]) == md.corpus_hash(docs.repartition(3), ["uuid", "number", "name", "kind", "body"])


def test_layouts_are_told_apart(spark, atoms, tmp_path):
    assert md.detect_layout(spark, atoms) == "atoms"
    (tmp_path / "none").mkdir()
    with pytest.raises(md.LayoutError):
        md.detect_layout(spark, str(tmp_path / "none"))
    open(f"{atoms}/A.0 - x.md", "w").close()
    with pytest.raises(md.LayoutError):
        md.detect_layout(spark, atoms)


def test_strict_and_lenient_atoms(spark):
    files = spark.createDataFrame([("a", atom(*ATOMS["A/0"])), ("b", "---\nid: 1\n---\n"), ("c", "no front matter")], "path string, text string")
    assert md.parsed_atoms(files, strict=False).count() == 1
    with pytest.raises(Exception, match="incomplete front matter"):
        md.parsed_atoms(files).collect()


def test_tar_members(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for folder, doc in ATOMS.items():
            data = atom(*doc).encode()
            info = tarfile.TarInfo(f"root/{folder}/document.md")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    assert md.tar_atoms(spark, str(tmp_path / "x.tar")).count() == len(ATOMS)


def test_code_fences_hold_no_titles_and_extra_fields(spark):
    title = f"# A.1 - T [Scope]  <!-- UUID: {U.format(1)} -->"
    text = f"{title}\n\n```\n{title}\n```\nend"
    assert md.parsed_monolith(spark.createDataFrame([("p", text)], "path string, text string")).count() == 1
    assert md.parsed_monolith(spark.createDataFrame([("p", text)], "path string, text string")).head().body == f"```\n{title}\n```\nend"
    fields = spark.range(1).select(md.extra_fields(F.lit("intro\n**One**: a\nb\n**Two**:\nc"), ["One", "Two", "Three"]).alias("m")).head().m
    assert fields == {"One": "a\nb", "Two": "c", "Three": ""}
    bad = spark.createDataFrame([("p", f"{title}\n### A.1.1 - X [Scope]  <!-- UUID: {U.format(2)} -->\n## A.1.2 - X [Nope]  <!-- UUID: {U.format(3)} -->\n# broken [Scope]")], "path string, text string")
    assert {(r.line, r.issue) for r in md.title_issues(bad, ["Scope"]).collect()} == {(1, "level"), (2, "kind"), (3, "format")}


def test_writers_and_pins(spark, atoms, tmp_path):
    docs = md.load(spark, atoms)
    md.write_monolith(docs, str(tmp_path / "m"))
    md.write_scopes(docs, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "m")).count() > 5 and {r.scope for r in spark.read.text(str(tmp_path / "s")).select("scope").distinct().collect()} == {"A.0", "NR-1"}
    docs.withColumn("corpus_hash", F.lit("h")).write.parquet(str(tmp_path / "p"))
    assert md.pinned(spark, str(tmp_path / "p"), "h").count() == 5 and md.pinned(spark, str(tmp_path / "p"), "x") is None and md.pinned(spark, str(tmp_path / "gone"), "h") is None


def test_tree_of_a_long_chain(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0) for i in range(150)], "id long, parent long, ord int")
    assert tr.closure(nodes).count() == 150 * 151 // 2
    assert tr.flattened(nodes).agg(F.max("depth")).head()[0] == 149


@pytest.mark.parametrize("edges", [[(1, 1)], [(1, 2), (2, 3), (3, 1), (4, 1)], [(i, (i + 1) % 9) for i in range(9)]])
def test_cycles_raise(spark, edges):
    with pytest.raises(ValueError, match="own ancestors"):
        tr.closure(spark.createDataFrame(edges, "id long, parent long"))


def test_changes(spark):
    base = spark.createDataFrame([(1, "1", "a", "x"), (2, "2", "b", "see [A.1 - T]"), (3, "3", "c", "z"), (4, "4", "d", "q")], "id long, number string, name string, body string")
    head = spark.createDataFrame([(1, "9", "a", "x"), (2, "2", "b", "see [A.2 - T]"), (3, "3", "c", "zz"), (5, "5", "e", "n")], "id long, number string, name string, body string")
    assert {r.id: r.status for r in vs.classified(base, head).collect()} == {2: "renumbered", 3: "modified", 4: "removed", 5: "new"}
    row = vs.word_diff(spark.createDataFrame([(1, "a b c d e f g h", "a X c Y e f g h")], "id long, old string, new string")).head()
    assert row.html == "a <del>b c d</del> <ins>X c Y</ins> e f g h" and (row.kept, row.removed, row.added) == (5, 3, 3)


def test_metrics_credit_a_unit_once(spark):
    rankings = spark.createDataFrame([("q", i + 1, d) for i, d in enumerate("abcd")] + [("e", 1, "a")], "query string, rank int, doc string")
    judgments = spark.createDataFrame([("q", 1, 2, "a"), ("q", 1, 2, "b"), ("q", 2, 1, "c"), ("q", 3, 1, "z"), ("e", 4, -1, "a")], "query string, unit int, grade int, doc string")
    rows = {r.query: r for r in ev.metrics(rankings, judgments).collect()}
    assert rows["q"].recall10 == pytest.approx(2 / 3, abs=1e-6) and rows["q"].mrr == 1 and 0.8 < rows["q"].ndcg10 < 1
    assert rows["e"].ndcg10 == 0 and rows["e"].recall10 == 1
    more = {r.query: r for r in ev.exact_metrics(rankings, judgments).collect()}
    assert more["q"].precision5 == 0.6 and more["q"].forbidden == 0 and more["e"].precision5 == 0 and more["e"].forbidden == 1
    assert ev.bootstrap([1.0] * 5) == (1.0, 1.0, 1.0)
    low, high = ev.bootstrap([0.0, 1.0] * 20)[1:]
    assert low < 0.5 < high and ev.bootstrap([0.0, 1.0] * 20) == ev.bootstrap([0.0, 1.0] * 20)


def test_longest_alias_wins_and_words_are_used_once(spark):
    docs = spark.createDataFrame([(1, "red widget ring small".split()), (2, "widget ring".split())], "id long, words array<string>")
    aliases = spark.createDataFrame([("red widget", "RW"), ("widget", "W"), ("widget ring", "WR"), ("small", "S")], "alias string, entity string")
    assert {(r.id, r.entity) for r in gr.longest_aliases(docs, aliases).collect()} == {(1, "RW"), (1, "S"), (2, "WR")}


def test_rerank_without_weight_changes_nothing(spark):
    rows = spark.createDataFrame([(i, i // 3, float(9 - i), i + 1, float(i % 2)) for i in range(9)], "id long, tier int, score double, rank int, signal double")
    assert all(r.position == r["rank"] for r in gr.reranked(rows, "signal", 0.0).collect())


def test_near_pairs_hold_identical_and_edited_bodies(spark):
    base = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, base), (2, base.upper()), (3, base.replace("w69", "x")), (4, "too short"), (5, " ".join(f"v{i}" for i in range(70)))], "id long, content string")
    assert {(r.a, r.b) for r in sim.near_pairs(docs).collect()} == {(1, 3)}


def test_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if v[i] @ v[j] >= 0.9}
    assert {(r.a, r.b) for r in sim.cosine_links(rows, (0.9,), pivots=12).collect()} == want
    top = sim.vector_topk(rows, rows.filter("id < 3").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 5).collect()
    for q in range(3):
        order = [i for i in sorted(range(300), key=lambda i: (-round(v[i] @ v[q], 6), i)) if i != q][:5]
        assert [r.id for r in sorted((r for r in top if r.query_id == q), key=lambda r: r["rank"])] == order


def test_blank_lines_and_quotes(spark):
    lines = spark.createDataFrame([("d", 1, "# A"), ("d", 2, "text"), ("d", 3, "## B"), ("d", 4, "")], "doc string, line int, text string")
    assert [(r.doc, r.line) for r in qa.blank_line_issues(lines).collect()] == [("d", 1)]
    claims = spark.createDataFrame([(1, 1, "“Exactly   these words”"), (2, 1, "short"), (3, 9, "not in any document")], "claim int, doc int, quote string")
    docs = spark.createDataFrame([(1, 'He said "exactly these words" twice')], "doc int, text string")
    assert {r.claim: r.faithful for r in qa.verified(claims, docs).collect()} == {1: True, 2: False, 3: False}


def test_rate_limiter_replays():
    limiter = st.RateLimiter(per_client=2, overall=3, window_ms=1000, most_clients=2)
    assert [limiter.ask("a", t)[0] for t in (0, 1, 2)] == [True, True, False] and limiter.ask("a", 2) == (False, 1)
    assert limiter.ask("b", 3) == (True, 0) and limiter.ask("c", 4)[0] is False and limiter.ask("a", 1000)[0]


def test_stateful_stream_limits_each_client(spark, tmp_path):
    rows = [(1, 0), (1, 10), (1, 20), (2, 5), (1, 70_000)]
    spark.createDataFrame(rows, "client long, at_ms long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client long, at_ms long").parquet(str(tmp_path / "in"))
    st.drained(st.client_limiter(stream, 2), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.client, r.at_ms): r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 0): True, (1, 10): True, (1, 20): False, (2, 5): True, (1, 70_000): True}


def test_cache_expires_and_forgets():
    cache, made = st.ExpiringCache(2, 100), []
    make = lambda k: cache.get(k, make.now, lambda: made.append(k) or k)
    for k, now in (("a", 0), ("a", 50), ("a", 100), ("b", 100), ("c", 100), ("a", 101)):
        make.now = now
        make(k)
    assert made == ["a", "a", "b", "c", "a"]
