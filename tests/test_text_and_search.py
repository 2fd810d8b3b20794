import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fulltext as ft
from corpusloom.operators import keyword as kw
from corpusloom.operators import query_syntax as qs
from corpusloom.operators import segments as sg


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(
    "text, tokens",
    [("Crème Brûlée", ["creme", "brulee"]), ("a.b.c. -x-", ["a.b.c", "x"]), ("co-op, 1.5%", ["co-op", "1.5"]), ("", []), (None, []), ("..--..", []), ("été", ["ete"]), ("non‑breaking", ["non-breaking"])],
)
def test_raw_tokens(spark, text, tokens):
    assert value(spark, tx.raw_tokens(F.lit(text).cast("string"))) == tokens


@pytest.mark.parametrize("token, pieces", [("co-op", ["co", "op", "coop"]), ("10-20", ["10", "20"]), ("a-b-c-d", ["a", "b", "c", "d"]), ("a.b-c", ["a.b-c"]), ("plain", ["plain"])])
def test_compound_pieces(spark, token, pieces):
    assert value(spark, tx.compound_pieces(F.lit(token))) == pieces


def test_query_side_joins_compounds_and_keeps_a_prefix():
    assert tx.query_terms("the Co-op of") == ["coop"]
    assert tx.query_terms("in the", trailing_prefix=True) == ["the"] and tx.query_terms("in the ", trailing_prefix=True) == []


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("controll", "control"), ("sky", "sky"), ("v1.5", "v1.5"), ("été", "été")])
def test_porter(word, stem):
    assert tx.porter_stem(word) == stem


def test_shingles_and_jaccard(spark):
    s = lambda t: tx.shingles(tx.words(F.lit(t)))
    assert value(spark, s("a b c d")) == ["a b c", "b c d"] and value(spark, s("a b")) == ["a b"] and value(spark, s("")) == []
    assert value(spark, tx.jaccard(s(""), s(""))) == 1 and value(spark, tx.jaccard(s("a b c d"), s("a b c e"))) == pytest.approx(1 / 3)


def test_small_functions(spark):
    assert value(spark, tx.strip_links(F.lit("see [this](http://x) and [that](y)"))) == "see this and that"
    assert value(spark, tx.slug(F.lit("  A b/C! "))) == "a-b-c"
    assert value(spark, tx.hyphenated_uuid(F.lit("0" * 31 + "A"))) == "00000000-0000-0000-0000-00000000000a"
    assert value(spark, tx.valid_uuid(F.lit("00000000-0000-0000-0000-00000000000"))) is False
    assert value(spark, tx.first_sentence(F.lit("One. Two."))) == "One."


DOCS = [(1, "Apache License", "the apache license text", "en", "a", 0), (2, "Notes", "license and license again", "en", "b", 2), (3, "Other", "nothing here", "de", "a", 5), (4, "Apache", "apache licensing", "de", "b", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, name string, content string, kind string, scope string, depth int")


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_strict_relaxed_and_filters(docs):
    assert ids(kw.search_all(docs, ["apache", "license"])) == [1]
    assert ids(kw.tiers(docs, ["apache", "license"]))[0] == 1 and set(ids(kw.tiers(docs, ["apache", "license"]))) == {1, 2, 4}
    assert ids(kw.tiers(docs, ["apache", "license"], limit=1)) == [1]
    assert ids(kw.search_all(docs, ["apache"], where=F.col("kind") == "de")) == [4]
    assert ids(kw.search_all(docs, ["license"], fields=("name",))) == [1]


def test_fuzzy_only_for_unknown_long_plain_words(docs):
    words = kw.vocabulary(docs)
    near = lambda t: {r.term for r in kw.expand_fuzzy(words, t).collect()}
    assert near("licence") == {"license"} and near("license") == {"license"} and near("nte") == set() and near("not.es") == set()
    assert {r.term for r in kw.expand_prefix(words, "l").collect()} == set() and {r.term for r in kw.expand_prefix(words, "licens").collect()} == {"license", "licensing"}


def test_written_index_ranks_like_the_scan(spark, docs, tmp_path):
    kw.write_index(docs, str(tmp_path / "i"), "h1", buckets=4)
    found = kw.search_index(spark, str(tmp_path / "i"), ["apache", "license"], corpus_hash="h1")
    assert ids(found) == [1]
    for terms in (["license"], ["apache", "license"], ["license", "version"]):
        same = lambda df: [(r.id, r.score) for r in df.orderBy("rank").collect()]
        assert same(kw.search_index(spark, str(tmp_path / "i"), terms)) == same(kw.search_all(docs, terms))
    assert kw.search_index(spark, str(tmp_path / "i"), ["apache"], corpus_hash="h2") is None


def test_interleave_promote_and_evidence(docs):
    ranked = kw.search_all(docs, ["license"])
    assert ids(kw.promoted(ranked, ids(ranked)[-1], 1))[0] == ids(ranked)[-1]
    assert {r.id: r.evidence for r in kw.match_evidence(docs, "license").collect()} == {1: 0, 2: 0, 4: 1}
    assert {r.id for r in kw.exact_window(docs, ["apache", "license"]).collect()} == {1}


def test_query_syntax():
    p = qs.parse("""rules type:"Scenario Variation" in:A.1.2 title:Core "two words" 'Exact' -slow type:""")
    assert p.types == ["Scenario Variation"] and p.scopes == ["A.1.2"] and p.title_only and p.phrases == ["two words"] and p.exact == ["Exact"] and p.excluded == ["slow"]
    assert p.terms == "rules type: Core two words Exact"
    assert qs.parse("A491d7d0-12").jump == "a491d7d012" and qs.parse("12345678").jump is None
    assert qs.parse("what's 'open").exact == [] and qs.parse('an "open').phrases == [] and qs.parse("a -").excluded == []
    assert qs.is_identifier_query("0xAb12 deadbeef1") and not qs.is_identifier_query("dead") and not qs.is_identifier_query("")
    assert qs.rewritten("the Boss rule", {"boss": ("facilitator", 7)}) == ("the facilitator rule", 7)
    assert qs.question("What is the Core?") == ("definition", "Core") and qs.question("how many agents are there?") == ("count", "agents") and qs.question("why") is None


def test_phrases_need_word_boundaries(spark):
    rows = spark.createDataFrame([(1, "The Quick fox"), (2, "quickest fox"), (3, "été quick")], "id long, content string")
    got = lambda **k: {r.id for r in rows.filter(kw.phrase_filter(F.col("content"), **k)).collect()}
    assert got(phrases=["quick"]) == {1, 3} and got(exact=["quick"]) == {3} and got(phrases=["quick"], excluded=["fox"]) == {3} and got(phrases=["t"]) == set()


def test_permutation_keeps_every_row(spark):
    rows = [(0, i, i, f"s{i % 7 if i < 40 else i % 3}", [float(i % 5), 1.0]) for i in range(80)]
    out = sg.permuted(spark.createDataFrame(rows, "query long, id long, rank int, segment string, v array<double>")).orderBy("position").collect()
    assert sorted(r.id for r in out) == list(range(80)) and [r.position for r in out] == list(range(80)) and out[0].id == 0


def test_excerpts_merge_and_stay_in_budget(spark):
    text = "x" * 500 + " license " + "y" * 20 + " copyright " + "z" * 500
    got = value(spark, sg.excerpts(F.lit(text), ["license", "copyright"]))
    assert "license" in got and "copyright" in got and len(got) <= 300 and "…" not in got
    assert value(spark, sg.excerpts(F.lit("abc"), ["nope"])) == "abc"


FIELD_BOOST = {"doc_no": 5.0, "name": 3.0, "content": 1.0, "extras": 1.0, "expansion": 0.25}
STOP = set(tx.STOP_WORDS)


def plain_tokens(field, text):
    """Index terms by the rules, for texts of ASCII letters, digits, dots and hyphens."""
    if field == "doc_no":
        return [text.strip().lower()] if text and text.strip() else []
    out = []
    for t in re.findall(r"[a-z0-9]+(?:[.-]+[a-z0-9]+)*", (text or "").lower()):
        parts = [p for p in t.split("-") if p]
        joined = "".join(parts)
        pieces = [t] if "." in t or "-" not in t else parts + ([joined] if len(parts) <= 3 and not joined.isdigit() else [])
        for w in pieces:
            if "." in w or w not in STOP:
                out.append(w)
                if "." not in w and tx.porter_stem(w) != w:
                    out.append(tx.porter_stem(w))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_scores(rows, terms, fields):
    tokens = {(r["id"], f): plain_tokens(f, r[f]) for r in rows for f in FIELD_BOOST}
    vocabulary = {t for ts in tokens.values() for t in ts}
    stats = {f: (sum(len(set(tokens[r["id"], f])) for r in rows) / len(rows)) for f in FIELD_BOOST}
    scores = {}
    for q in dict.fromkeys(terms):
        weights = {}
        for t in vocabulary:
            longer = len(t) - len(q)
            if t == q:
                weights[t] = 1.0
            elif len(q) >= 2 and t.startswith(q):
                weights[t] = 0.375 * len(t) / (len(t) + 0.3 * longer)
            elif q not in vocabulary and len(q) >= 4 and "." not in q and (d := edits(q, t)) <= int(0.2 * len(q) + 0.5):
                weights[t] = 0.45 * len(t) / (len(t) + d)
        for t, weight in weights.items():
            for f in fields:
                df = sum(t in tokens[r["id"], f] for r in rows)
                for r in rows:
                    if tf := tokens[r["id"], f].count(t):
                        idf = math.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
                        long = len(set(tokens[r["id"], f])) / stats[f]
                        scores.setdefault(r["id"], {}).setdefault(q, []).append(weight * FIELD_BOOST[f] * idf * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * long))))
    depth = {r["id"]: r["depth"] for r in rows}
    return {d: (round(sum(sum(p) for p in by.values()) * len(by) * (1 + max(0, 4 - depth[d]) * 0.05), 5), len(by)) for d, by in scores.items()}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """Documents with all five fields, their index, and their rows."""
    rng = random.Random(3)
    words = "compensation compensated delegate delegates off-chain offchain governance slope scope licensing license a.1.6 a.1.6.4 the of slippery relational rules vote voting voter".split()
    rows = [{"id": i, "doc_no": f"A.1.{i}", "name": " ".join(rng.choices(words, k=3)), "content": " ".join(rng.choices(words, k=rng.randint(0, 25))), "extras": rng.choice([None, "extra vote"]), "expansion": rng.choice(["", "payment delegate"]), "depth": i % 6} for i in range(40)]
    path = str(tmp_path_factory.mktemp("library"))
    ft.write_index(spark.createDataFrame(rows, "id long, doc_no string, name string, content string, extras string, expansion string, depth int"), path)
    return ft.Index(spark, path), rows


@pytest.mark.parametrize("query", ["how are delegates compensated", "compensaton rules ", "off-chain vote", "slope", "scop", "A.1.6", "licensing vot", "delgate governance ", "a.1.1"])
@pytest.mark.parametrize("limit", [5, 100])
def test_index_search_matches_brute_force(library, query, limit):
    index, rows = library
    plain = tx.query_terms(query, trailing_prefix=True)
    stemmed = [tx.porter_stem(t) for t in plain]
    first = plain_scores(rows, stemmed, FIELD_BOOST)
    order = lambda found: sorted(found, key=lambda r: (r[1], -r[2], r[0]))
    want = order([(d, 0 if n == len(set(stemmed)) else 1, s) for d, (s, n) in first.items()])
    if sum(t == 0 for _, t, _ in want) >= limit:
        want = [r for r in want if r[1] == 0]
    elif plain != stemmed:
        want += order([(d, 2, s) for d, (s, _) in plain_scores(rows, plain, FIELD_BOOST).items() if d not in first])
    got = [(r.id, r.tier, r.score) for r in index.search(query, limit).orderBy("rank").collect()]
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want[:limit]]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want[:limit]], abs=2e-5)


def test_index_search_of_fields_among_and_nothing(library, spark):
    index, rows = library
    got = {r.id for r in index.search("vote", fields=("extras",)).collect()}
    assert got == {r["id"] for r in rows if r["extras"]}
    assert {r.id for r in index.search("vote", among=spark.createDataFrame([(3,), (4,)], "id long")).collect()} <= {3, 4}
    assert index.search("of the ").count() == 0 and [r.id for r in index.jump(" a.1.7 ").collect()] == [7]
