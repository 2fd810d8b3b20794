"""Vector search and duplicate analysis over the driver's embeddings and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import keyword as kw
from corpusloom.operators import similarity as sim
from corpusloom.plans import sqltext as sq
from corpusloom.session import table


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _queries(s, d):
    """The stated query set: every row whose id is divisible by 100."""
    return vectors(s, d).filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"))


def docs(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", F.coalesce("text", F.lit("")).alias("content"))


def _first(s, d):
    return vectors(s, d).orderBy("id").select("v").head()[0]


def _dense(s, d):
    return sim.vector_topk(vectors(s, d), vectors(s, d).filter("id = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 200)


def _rung(s, d):
    ranked = _dense(s, d).join(vectors(s, d).select("id", "label"), "id")
    return sim.first_per_family(ranked, "label", 10).select("id", "label", "rank", "score")


def _hybrid(s, d):
    flat = kw.flat_documents(table(s, d, "documents"))
    ranked = kw.scored(flat, ["apache", "license"])
    strict = kw.top(ranked.filter("matched = 2 AND kind = 'es'"), 8).select("id", "rank")
    relaxed = kw.top(ranked.filter("matched = 1"), 20).select("id", "rank")
    dense = _dense(s, d).join(vectors(s, d).select("id", F.col("label").alias("family")), "id").select("id", "rank", "score", "family")
    return sim.composed(strict, dense, relaxed, "family")


def _u8(s, d):
    v = vectors(s, d)
    codes = sim.quantised(v, sim.codebook(v))
    return codes.select("id", F.posexplode("q").alias("dim", "code")).groupBy("id").agg(F.sum("code").alias("code_sum"), F.sum(F.col("code") * (F.col("dim") + 1)).alias("weighted"))


def _u8_topk(s, d):
    v = vectors(s, d)
    book = sim.codebook(v)
    found = sim.quantised_scores(sim.quantised(v, book), book, _first(s, d)).orderBy(F.desc("score"), "id").limit(10)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _centred(s, d):
    moved = sim.centred(vectors(s, d))
    return sim.vector_topk(moved, moved.filter("id = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 10).select("id", "score", "rank")


def _fragments(s, d):
    rows = docs(s, d).select("id", F.posexplode(sim.fragments(F.col("content"))).alias("fragment", "piece"))
    return rows.select(F.col("id").alias("doc"), "fragment", "piece", F.round(F.size(F.filter(tx.raw_tokens(F.col("piece")), lambda t: t == "the")) / F.greatest(F.size(tx.raw_tokens(F.col("piece"))), F.lit(1)), 6).alias("score"))


def _fragment_rrf(s, d):
    f = _fragments(s, d)
    lists = f.filter("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("fragment").orderBy(F.desc("score"), "doc"))).filter("rank <= 100")
    return sim.rrf(lists.select(F.col("fragment").alias("list"), F.col("doc").alias("id"), "rank"))


def _near_families(s, d):
    """Representatives' families joined back to every document: (id, family_id)."""
    flat = docs(s, d)
    labels = sim.components(sim.near_pairs(flat))
    bodies = flat.select("id", F.md5(tx.normalized(F.col("content"))).alias("body_id"), F.size(tx.words(F.col("content"))).alias("n")).filter(F.col("n") >= sim.LEAST_WORDS)
    first = bodies.groupBy("body_id").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    family = first.join(labels, first["first"] == labels["node"], "left").withColumn("family_id", F.coalesce("label", "first")).filter("label IS NOT NULL OR copies > 1")
    return bodies.join(family.select("body_id", "family_id"), "body_id").select("id", "family_id")


def _census(s, d):
    flat = docs(s, d).withColumn("body", tx.normalized(F.col("content"))).filter("body <> ''")
    same = sim.families(flat.select(F.md5("body").alias("k"), "id"), "k", "id")
    large = sim.families(flat.filter(F.length("body") >= sim.SUBSTANTIAL).select(F.md5("body").alias("k"), "id"), "k", "id")
    return same.select(F.lit("identical").alias("definition"), "size").unionByName(large.select(F.lit("substantial").alias("definition"), "size")).groupBy("definition").agg(
        F.count(F.lit(1)).alias("families"), F.sum("size").alias("documents"), F.max("size").alias("largest"))


def _sweep(s, d):
    found = sim.cosine_counts(vectors(s, d), (0.4, 0.45, 0.5))
    return found.select(*[F.col(f"t{i}").alias(f"pairs_{t}") for i, t in enumerate((40, 45, 50))])


def _cosine_families(s, d):
    return sim.components(sim.cosine_links(vectors(s, d), (0.4,)).select("a", "b")).select(F.col("node").alias("id"), F.col("label").alias("family_id"))


def _rrf(s, d):
    a = sim.vector_topk(vectors(s, d), _queries(s, d), 50)
    return sim.rrf(a.select(F.col("query_id").alias("list"), "id", "rank"))


def _cross_check(s, d):
    """Documents judged of one quality class against those of the same toxicity: missing and extra by class."""
    labels = table(s, d, "labels")
    a, b = labels.filter("quality = 1").select("doc_id"), labels.filter("toxic = 0").select("doc_id")
    missing = a.join(b, "doc_id", "left_anti").select(F.lit("missing").alias("side"), "doc_id")
    return missing.unionByName(b.join(a, "doc_id", "left_anti").select(F.lit("extra").alias("side"), "doc_id"))


QUERIES = {
    "vector_topk": lambda s, d: sim.vector_topk(vectors(s, d), _queries(s, d), 10),
    "vector_topk_filtered": lambda s, d: sim.vector_topk(vectors(s, d).filter("label % 2 = 1"), _queries(s, d), 5),
    "u8_quantise": _u8,
    "u8_topk": _u8_topk,
    "centroid_removed_topk": _centred,
    "first_per_family_topk": _rung,
    "hybrid_compose": _hybrid,
    "rrf_fuse": _rrf,
    "fragments": lambda s, d: _fragments(s, d).select("doc", "fragment", F.md5("piece").alias("digest"), F.length("piece").alias("n")),
    "max_pool": lambda s, d: sim.max_pool(_fragments(s, d)),
    "topk_weighted": lambda s, d: sim.best_two(_fragments(s, d)),
    "rrf_over_fragments": _fragment_rrf,
    "identical_bodies": lambda s, d: sim.families(docs(s, d).select(F.md5(tx.normalized(F.col("content"))).alias("k"), "id"), "k", "id"),
    "identical_substantial": lambda s, d: sim.families(docs(s, d).filter(F.length(tx.normalized(F.col("content"))) >= sim.SUBSTANTIAL).select(F.md5(tx.normalized(F.col("content"))).alias("k"), "id"), "k", "id"),
    "census_summary": _census,
    "near_duplicate_pairs": lambda s, d: sim.near_pairs(docs(s, d)),
    "near_duplicate_families": _near_families,
    "cosine_pairs_sweep": _sweep,
    "cosine_families": _cosine_families,
    "same_key_same_parent": lambda s, d: table(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("size"), F.min("c_custkey").alias("first")).filter("size >= 2"),
    "same_key_mixed_parent": lambda s, d: table(s, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("p_brand").alias("parents")).filter("parents > 1"),
    "collapse_families": lambda s, d: sim.first_per_family(_dense(s, d).join(vectors(s, d).select("id", "label"), "id"), "label", 1000).select("id", "label", "rank"),
    "family_cross_check": _cross_check,
}

_COS = "round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"
_DENSE = f"""dense AS (SELECT v.vec_id AS id, v.label, {_COS.format(a="v.embedding", b="q.embedding")} AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0 AND v.vec_id <> 0),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM dense ORDER BY score DESC, id LIMIT 200)"""


def _topk(k, keep="true"):
    return f"""SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM
(SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS.format(a="v.embedding", b="q.embedding")} AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 AND {keep})) WHERE rank <= {k}"""


_DIMS = "e AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim FROM embeddings)"
_BOOK = f"{_DIMS}, book AS (SELECT dim, min(x) AS low, CASE WHEN max(x) = min(x) THEN 1.0::DOUBLE ELSE (max(x) - min(x)) / 255 END AS step FROM e GROUP BY dim), codes AS (SELECT id, dim, CAST(floor((x - low) / step + 0.5::DOUBLE) AS BIGINT) AS code FROM e JOIN book USING (dim))"
_THE = f"round(len(list_filter({sq.raw_tokens('piece')}, lambda t: t = 'the')) / greatest(len({sq.raw_tokens('piece')}), 1)::DOUBLE, 6)"
_FRAG = f"""pieces AS (SELECT doc_id AS doc, unnest(range(0, greatest(length(coalesce(text, '')) - 541, 0) + 1, 3060)) AS start, coalesce(text, '') AS text FROM documents),
frag AS (SELECT doc, CAST(start // 3060 AS INTEGER) AS fragment, substr(text, start + 1, 3600) AS piece FROM pieces), f AS (SELECT doc, fragment, piece, {_THE} AS score FROM frag)"""
_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ')"
_BODY = f"n AS (SELECT doc_id AS id, {_NORM} AS body FROM documents), b AS (SELECT md5(body) AS k, min(id) AS first, count(*) AS copies, min(body) AS body FROM n WHERE len(string_split(body, ' ')) >= 15 GROUP BY 1)"
_SH = f"""{_BODY}, w AS (SELECT first AS doc, string_split(body, ' ') AS w FROM b),
sh AS (SELECT DISTINCT doc, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc, w, unnest(range(1, len(w) - 1)) AS i FROM w)), cnt AS (SELECT doc, count(*) AS n FROM sh GROUP BY doc),
near AS (SELECT x.doc AS a, y.doc AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc < y.doc GROUP BY 1, 2),
pairs AS (SELECT a, b, round(k / (p.n + q.n - k)::DOUBLE, 6) AS jaccard FROM near JOIN cnt p ON p.doc = a JOIN cnt q ON q.doc = b WHERE k / (p.n + q.n - k)::DOUBLE >= 0.9)"""
_REACH = """both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a)"""


def _families(key, where="true"):
    return f"SELECT md5({key}) AS k, count(*) AS size, min(doc_id) AS first FROM documents WHERE {where} GROUP BY 1 HAVING count(*) >= 2"


_CPAIRS = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE " + _COS.format(a="a.embedding", b="b.embedding")

SQL = {
    "vector_topk": _topk(10),
    "vector_topk_filtered": _topk(5, "v.label % 2 = 1"),
    "u8_quantise": f"WITH {_BOOK} SELECT id, CAST(sum(code) AS BIGINT) AS code_sum, CAST(sum(code * (dim + 1)) AS BIGINT) AS weighted FROM codes GROUP BY id",
    "u8_topk": f"""WITH {_BOOK}, q AS (SELECT dim, x AS u FROM e WHERE id = 0), sc AS (SELECT id, round(sum(code * step * u) + (SELECT sum(u * low) FROM q JOIN book USING (dim)), 6) AS score FROM codes JOIN book USING (dim) JOIN q USING (dim) GROUP BY id)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc ORDER BY score DESC, id LIMIT 10""",
    "centroid_removed_topk": f"""WITH {_DIMS}, m AS (SELECT dim, avg(x) AS m FROM e GROUP BY dim), c AS (SELECT id, dim, x - m AS x FROM e JOIN m USING (dim)), l AS (SELECT id, sqrt(sum(x * x)) AS l FROM c GROUP BY id),
u AS (SELECT id, dim, x / l AS x FROM c JOIN l USING (id)), sc AS (SELECT u.id, round(sum(u.x * q.x), 6) AS score FROM u JOIN u q ON q.id = 0 AND q.dim = u.dim WHERE u.id <> 0 GROUP BY u.id)
SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc ORDER BY score DESC, id LIMIT 10""",
    "first_per_family_topk": f"WITH {_DENSE} SELECT id, label, rank, score FROM ranked QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank) = 1 ORDER BY rank LIMIT 10",
    "hybrid_compose": f"""WITH {sq.scored(["apache", "license"])}, {_DENSE},
strict AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE matched = 2 AND kind = 'es' ORDER BY score DESC, id LIMIT 8),
relaxed AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE matched = 1 ORDER BY score DESC, id LIMIT 20),
rung AS (SELECT id, rank, score FROM ranked WHERE id NOT IN (SELECT id FROM strict) AND (score >= 0.6 OR id NOT IN (SELECT id FROM relaxed)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank) = 1 ORDER BY rank LIMIT 10),
every AS (SELECT id, 0 AS tier, rank, false AS weak FROM strict UNION ALL SELECT id, 1, rank, score < 0.6 FROM rung WHERE (SELECT count(*) FROM strict) < 10
UNION ALL SELECT id, 2, rank, false FROM relaxed WHERE id NOT IN (SELECT id FROM strict) AND id NOT IN (SELECT id FROM rung WHERE (SELECT count(*) FROM strict) < 10))
SELECT id, tier, CAST(rank AS INTEGER) AS rank, weak, CAST(row_number() OVER (ORDER BY tier, rank) AS INTEGER) AS position FROM every""",
    "rrf_fuse": f"WITH r AS ({_topk(50)}) SELECT id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, min(rank) AS best_rank, min(query_id) AS first_list FROM r GROUP BY id",
    "fragments": f"WITH {_FRAG} SELECT doc, fragment, md5(piece) AS digest, CAST(length(piece) AS INTEGER) AS n FROM frag",
    "max_pool": f"WITH {_FRAG} SELECT doc, max(score) AS score FROM f GROUP BY doc",
    "topk_weighted": f"WITH {_FRAG}, r AS (SELECT doc, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, fragment) AS p FROM f) SELECT doc, round(sum(CASE WHEN p = 1 THEN score ELSE 0.5::DOUBLE * score END), 8) AS score FROM r WHERE p <= 2 GROUP BY doc",
    "rrf_over_fragments": f"WITH {_FRAG}, r AS (SELECT doc, fragment, row_number() OVER (PARTITION BY fragment ORDER BY score DESC, doc) AS rank FROM f WHERE score > 0) SELECT doc AS id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score, CAST(min(rank) AS INTEGER) AS best_rank, min(fragment) AS first_list FROM r WHERE rank <= 100 GROUP BY doc",
    "identical_bodies": _families(_NORM),
    "identical_substantial": _families(_NORM, f"length({_NORM}) >= 200"),
    "census_summary": f"""WITH n AS (SELECT {_NORM} AS body FROM documents), g AS (SELECT 'identical' AS definition, count(*) AS size FROM n WHERE body <> '' GROUP BY body HAVING count(*) >= 2
UNION ALL SELECT 'substantial', count(*) FROM n WHERE length(body) >= 200 GROUP BY body HAVING count(*) >= 2)
SELECT definition, count(*) AS families, CAST(sum(size) AS BIGINT) AS documents, max(size) AS largest FROM g GROUP BY definition""",
    "near_duplicate_pairs": f"WITH {_SH} SELECT a, b, jaccard FROM pairs",
    "near_duplicate_families": f"""WITH RECURSIVE {_SH}, {_REACH}, lab AS (SELECT a AS first, least(a, min(b)) AS label FROM reach GROUP BY a)
SELECT n.id, coalesce(label, b.first) AS family_id FROM n JOIN b ON md5(n.body) = b.k LEFT JOIN lab ON lab.first = b.first WHERE label IS NOT NULL OR copies > 1""",
    "cosine_pairs_sweep": f"""WITH c AS (SELECT {_COS.format(a="a.embedding", b="b.embedding")} AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
SELECT count(*) FILTER (c >= 0.4) AS pairs_40, count(*) FILTER (c >= 0.45) AS pairs_45, count(*) FILTER (c >= 0.5) AS pairs_50 FROM c""",
    "cosine_families": f"WITH RECURSIVE pairs AS ({_CPAIRS} >= 0.4), {_REACH} SELECT a AS id, least(a, min(b)) AS family_id FROM reach GROUP BY a",
    "same_key_same_parent": "SELECT c_mktsegment, c_nationkey, count(*) AS size, min(c_custkey) AS first FROM customer GROUP BY 1, 2 HAVING count(*) >= 2",
    "same_key_mixed_parent": "SELECT p_name, count(*) AS size, count(DISTINCT p_brand) AS parents FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "collapse_families": f"WITH {_DENSE} SELECT id, label, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY label ORDER BY rank) = 1",
    "family_cross_check": """SELECT 'missing' AS side, doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)
UNION ALL SELECT 'extra', doc_id FROM labels WHERE toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
}
