"""Numbering, lexicon, artifact and scope queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import artifacts as ar
from corpusloom.operators import evaluation as ev
from corpusloom.operators import lexicon as lx
from corpusloom.operators import numbering as nb
from corpusloom.operators import similarity as sim
from corpusloom.operators import tree as tr
from corpusloom.operators import versions as vs
from corpusloom.plans.similarity_queries import vectors
from corpusloom.plans.structure_queries import _CLO, _GONE, _JUDGED, _NODES, asked, edges, judged, node_versions, nodes, postings
from corpusloom.session import table


def numbered(s, d):
    """Orders as documents of all kinds of numbers."""
    k, base = F.col("o_orderkey") % 8, F.concat(F.lit("A."), F.col("o_orderkey") % 5 + 1, F.lit("."), F.col("o_custkey") % 9)
    ends = [F.lit(""), F.concat(F.lit("."), F.col("o_orderkey")), F.concat(F.lit(".0.3."), "o_orderkey"), F.concat(F.lit(".0.6."), "o_orderkey"), F.concat(F.lit(".0.4."), "o_orderkey"), F.concat(F.lit(".0.4.1.1."), "o_orderkey"), F.concat(F.lit(".0.4.1.1.2.var"), "o_orderkey")]
    number = F.when(k == 7, F.concat(F.lit("NR-"), "o_orderkey"))
    for i, e in enumerate(ends):
        number = number.when(k == i, F.concat(base, e))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), number.alias("number"))


def _numbers(s, d):
    rows = numbered(s, d).withColumn("kind", nb.inferred_kind(F.col("number")))
    return rows.select("id", "number", "kind", nb.parent_number(F.col("number"), F.col("kind")).alias("parent"), nb.semantic_depth(F.col("number"), F.col("kind")).alias("depth"), nb.heading_level(F.col("number"), F.col("kind")).alias("level"))


def _issues(s, d):
    """Kinds shifted by one for some orders: their numbers no longer have the right form."""
    rows = numbered(s, d).withColumn("kind", nb.inferred_kind(F.when(F.col("id") % 10 == 0, F.concat("number", F.lit(".0.3.1"))).otherwise(F.col("number"))))
    return nb.number_issues(rows)


def _harvest(s, d):
    words = F.split("p_name", " ")
    rows = table(s, d, "part").select(F.upper(F.concat(F.substring(words[0], 1, 1), F.substring(words[1], 1, 1))).alias("acronym"), F.col("p_name").alias("phrase"))
    return rows.groupBy("acronym").agg(F.min("phrase").alias("phrase"))


def _curated(s, d):
    frame = lambda rows: s.createDataFrame(rows, "acronym string, phrase string")
    return lx.curated(_harvest(s, d), frame([("SR", None), ("QQ", None)]), frame([("RW", "red letter widget")]), frame([("ZZ", "added phrase"), ("SR", "not added")]))


def _entities(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.split(F.concat_ws(" ", F.lower("p_type"), "p_name"), " ").alias("words"))


def _related(s, d):
    strong = lx.surfaces(_entities(s, d), ["small", "ring", "promo"]).join(postings(s, d), "entity").groupBy("section").agg(F.max("strength").alias("strength"))
    fact = postings(s, d).join(F.broadcast(asked(s)), "entity").groupBy("section").agg(F.round(F.sum("count") / 10, 6).alias("strength"))
    return lx.related_results([fact, strong])


def _meanings(s, d):
    exp = _harvest(s, d).filter("acronym IN ('SR', 'RW', 'BG')")
    opp = s.createDataFrame([("open", "closed"), ("red", "blue")], "term string, opposite string")
    return lx.interpretations("the RW of an Open SR", exp, opp)


def _categories(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 3, F.concat_ws("/", "p_name", "p_brand", "p_type")).alias("name"), F.lit(None).cast("string").alias("parent"))
    near = s.createDataFrame([(1, 2), (2, 7)], "a long, b long")
    return sim.components(lx.categories(rows, near)).select(F.col("node").alias("id"), F.col("label").alias("category"))


def _incremental(s, d):
    rows = table(s, d, "benchmark").select(F.col("item_id").alias("key"), "text")
    make = lambda df: df.select("key", "hash", F.length("text").cast("long").alias("value"))
    first = ar.incremental(rows.filter("key % 2 = 0"), s.createDataFrame([], "key long, hash string, version string, value long"), make, "v1").withColumn("value", F.col("value") + 1000)
    return ar.incremental(rows, first, make, "v1").select("key", "hash", "value")


def _expansions(s, d):
    text = F.regexp_replace(F.left("text", F.lit(40)), r'["\\\n]', " ")
    answers = table(s, d, "benchmark").select(F.col("item_id").alias("key"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("no json "), text)).otherwise(F.concat(F.lit('Here: {"paraphrase": "'), text, F.lit('", "questions": ["a", " ", "b"]}'))).alias("answer"))
    return ar.parsed_expansions(answers).select("key", "paraphrase", F.array_join("questions", "|").alias("questions"))


def _scopes(s, d):
    base, head = node_versions(s, d)
    clo = tr.closure(base)
    roots = vs.scope_roots(base.join(head.select("id"), "id", "left_anti").select("id"), clo)
    return vs.grouped_scopes(roots, base, clo)


def _compared(s, d):
    from pyspark.sql import Window

    rankings, judgments = judged(s, d)
    other = rankings.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc")))
    return ar.compared(ev.metrics(other, judgments), ev.metrics(rankings, judgments), "mrr")


def _without_shared(s, d):
    v = vectors(s, d).select("id", "v")
    mean, axes = ar.shared_directions(v, 1)
    left = ar.without_directions(v, mean, axes)
    return left.select("id", F.round(sim.norm(F.col("v")), 6).alias("length"), F.round(sim.dot(F.col("v"), F.array(*[F.lit(x) for x in axes[0]])), 6).alias("along"))


QUERIES = {
    "numbers_read": _numbers,
    "number_issues": _issues,
    "abbreviations_curated": _curated,
    "entity_variants": lambda s, d: lx.variants(_entities(s, d), ["small", "ring"], 6),
    "surface_strength": lambda s, d: lx.surfaces(_entities(s, d), ["small", "ring", "promo"]),
    "related_results": _related,
    "entity_lexicon": lambda s, d: lx.lexicon(table(s, d, "customer").select(F.concat_ws(" ", "c_mktsegment", F.col("c_custkey") % 700).alias("name"), F.col("c_custkey").alias("entity"))),
    "interpretations": _meanings,
    "name_categories": _categories,
    "incremental_values": _incremental,
    "expansion_answers": _expansions,
    "request_lines": lambda s, d: ar.request_lines(table(s, d, "benchmark").select(F.col("item_id").alias("key"), F.regexp_replace("text", r'[^A-Za-z .,]', "").alias("prompt")), "m"),
    "prompt_documents": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(ar.prompt_document(F.col("doc_id").cast("string"), F.col("source"), F.col("text"))).alias("digest")),
    "scope_groups": _scopes,
    "scope_labels": lambda s, d: vs.scope_labels(nodes(s, d).filter("kind = 'nation'").select(F.col("id").alias("scope")), tr.paths(nodes(s, d))),
    "report_comparison": _compared,
    "shared_component_removed": _without_shared,
    "disambiguation_counts": lambda s, d: tr.closure(nodes(s, d)).join(nodes(s, d).filter("kind = 'customer'").select("id"), "id", "left_semi").groupBy("ancestor").agg(F.count(F.lit(1)).alias("within")),
    "supporting_groups": lambda s, d: nodes(s, d).groupBy("parent", "kind").agg(F.count(F.lit(1)).alias("n")).filter("parent IS NOT NULL"),
    "shared_neighbours": lambda s, d: edges(s, d).groupBy("o").agg(F.count_distinct("s").alias("suppliers")).filter("suppliers > 1"),
}

_NUMBERED = """num AS (SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 7 THEN 'NR-' || o_orderkey ELSE 'A.' || (o_orderkey % 5 + 1) || '.' || (o_custkey % 9) || CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN '.' || o_orderkey WHEN 2 THEN '.0.3.' || o_orderkey
  WHEN 3 THEN '.0.6.' || o_orderkey WHEN 4 THEN '.0.4.' || o_orderkey WHEN 5 THEN '.0.4.1.1.' || o_orderkey ELSE '.0.4.1.1.2.var' || o_orderkey END END AS number, o_orderkey % 8 AS k, o_orderkey % 5 + 1 AS r, o_custkey % 9 AS c FROM orders),
kinds AS (SELECT *, CASE k WHEN 7 THEN 'Needed Research' WHEN 0 THEN 'Article' WHEN 1 THEN 'Section' WHEN 2 THEN 'Annotation' WHEN 3 THEN 'Active Data' WHEN 4 THEN 'Action Tenet' WHEN 5 THEN 'Scenario' ELSE 'Scenario Variation' END AS kind, 'A.' || r || '.' || c AS base FROM num)"""
_ENT = "ent AS (SELECT p_partkey AS entity, string_split(lower(p_type) || ' ' || p_name, ' ') AS words FROM part)"
_STRONG = "strong AS (SELECT entity, round(len(list_intersect(['small', 'ring', 'promo'], words)) / 3.0::DOUBLE, 6) AS strength FROM ent)"
_HARVEST = "harvest AS (SELECT upper(string_split(p_name, ' ')[1][1] || string_split(p_name, ' ')[2][1]) AS acronym, min(p_name) AS phrase FROM part GROUP BY 1)"

SQL = {
    "numbers_read": f"""WITH {_NUMBERED} SELECT id, number, kind, CASE k WHEN 7 THEN NULL WHEN 0 THEN 'A.' || r WHEN 1 THEN base WHEN 2 THEN base WHEN 3 THEN base WHEN 4 THEN base WHEN 5 THEN base || '.0.4.1' ELSE base || '.0.4.1.1.2' END AS parent,
CAST(d AS INTEGER) AS depth, CAST(coalesce(d, 6) AS INTEGER) AS level FROM (SELECT *, CASE k WHEN 7 THEN NULL WHEN 0 THEN 2 WHEN 5 THEN 4 WHEN 6 THEN 5 ELSE 3 END AS d FROM kinds)""",
    "number_issues": f"""WITH {_NUMBERED}, x AS (SELECT number, CASE WHEN id % 10 = 0 AND k <> 7 THEN 'Annotation' ELSE kind END AS kind FROM kinds)
SELECT number, kind, 'format' AS issue FROM x WHERE kind = 'Annotation' AND NOT regexp_matches(number, '[.]0[.]3[.][0-9]+$') UNION ALL SELECT number, min(kind), 'duplicate' FROM x GROUP BY number HAVING count(*) > 1""",
    "abbreviations_curated": f"""WITH {_HARVEST} SELECT acronym, CASE WHEN acronym = 'RW' THEN 'red letter widget' ELSE phrase END AS phrase, CASE WHEN acronym = 'RW' THEN 'corrected' ELSE 'harvested' END AS source FROM harvest WHERE acronym NOT IN ('SR', 'QQ')
UNION ALL SELECT 'ZZ', 'added phrase', 'added' UNION ALL SELECT 'QQ', NULL, 'unused'""",
    "entity_variants": f"WITH {_ENT} SELECT entity FROM ent WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' small ring ') AND len(words) > 2 ORDER BY len(words), entity LIMIT 6",
    "surface_strength": f"WITH {_ENT}, {_STRONG} SELECT entity, strength FROM strong WHERE strength >= 0.66",
    "related_results": f"""WITH {_ENT}, {_STRONG}, p AS (SELECT l_partkey AS entity, l_orderkey AS section, count(*) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT section, 0 AS kind, round(sum(n) / 10.0::DOUBLE, 6) AS strength FROM p WHERE entity IN (1, 2, 3) GROUP BY 1 UNION ALL SELECT section, 1, max(strength) FROM p JOIN strong USING (entity) WHERE strength >= 0.66 GROUP BY 1),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY section ORDER BY kind, strength DESC) = 1)
SELECT section, kind, strength, CAST(row_number() OVER (ORDER BY kind, strength DESC, section) AS INTEGER) AS place FROM b ORDER BY kind, strength DESC, section LIMIT 20""",
    "entity_lexicon": "SELECT lower(c_mktsegment || ' ' || (c_custkey % 700)) AS name, min(c_custkey) AS entity FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1",
    "interpretations": f"""WITH {_HARVEST} SELECT 'expansion' AS kind, regexp_replace('the RW of an Open SR', '(?i)\\b' || acronym || '\\b', phrase, 'g') AS rewritten FROM harvest WHERE acronym IN ('SR', 'RW')
UNION ALL SELECT 'opposite', 'the RW of an closed SR'""",
    "name_categories": """WITH RECURSIVE c AS (SELECT p_partkey AS id, p_name || '/' || p_brand || '/' || p_type AS name FROM part WHERE p_size < 3), f AS (SELECT name, min(id) AS a FROM c GROUP BY name),
pairs(a, b) AS (SELECT a, id FROM c JOIN f USING (name) WHERE id <> a UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 7), both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a) SELECT a AS id, least(a, min(b)) AS category FROM reach GROUP BY a""",
    "incremental_values": "SELECT item_id AS key, sha256(text) AS hash, length(text) + CASE WHEN item_id % 2 = 0 THEN 1000 ELSE 0 END AS value FROM benchmark",
    "expansion_answers": r"""SELECT item_id AS key, regexp_replace(left(text, 40), '["\\\n]', ' ', 'g') AS paraphrase, 'a|b' AS questions FROM benchmark WHERE item_id % 3 <> 0""",
    "request_lines": r"""SELECT '{"custom_id":' || item_id || ',"body":{"model":"m","prompt":"' || left(regexp_replace(text, '[^A-Za-z .,]', '', 'g'), 4000) || '"}}' AS value FROM benchmark""",
    "prompt_documents": "SELECT doc_id, md5('[' || doc_id || '] ' || source || chr(10) || CASE WHEN length(text) > 4000 THEN left(text, 4000) || '…' ELSE text END) AS digest FROM documents",
    "scope_groups": f"""WITH RECURSIVE {_GONE}, roots AS (SELECT g.id, n.parent FROM gone g JOIN nodes n USING (id) WHERE g.id NOT IN (SELECT id FROM clo WHERE distance > 0 AND ancestor IN (SELECT id FROM gone))),
lift AS (SELECT parent FROM roots GROUP BY parent HAVING count(*) > 1 AND parent NOT IN (SELECT ancestor FROM clo WHERE distance > 1 AND id IN (SELECT id FROM roots)))
SELECT CASE WHEN parent IN (SELECT parent FROM lift) THEN parent ELSE id END AS scope, id AS root FROM roots""",
    "scope_labels": f"WITH {_NODES} SELECT id AS scope, id AS label FROM nodes WHERE kind = 'nation'",
    "report_comparison": f"""WITH {_JUDGED}, r2 AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM r), b AS (SELECT query, 1.0::DOUBLE / min(rank) AS mrr FROM r2 JOIN j USING (query, doc) WHERE grade > 0 GROUP BY query)
SELECT m.query, round(coalesce(b.mrr, 0), 6) AS before, m.mrr AS after, round(m.mrr - round(coalesce(b.mrr, 0), 6), 6) AS change FROM met m LEFT JOIN b USING (query)""",
    "shared_component_removed": "SELECT vec_id AS id, 1.0::DOUBLE AS length, 0.0::DOUBLE AS along FROM embeddings",
    "disambiguation_counts": f"WITH RECURSIVE {_CLO} SELECT ancestor, count(*) AS within FROM clo WHERE id IN (SELECT id FROM nodes WHERE kind = 'customer') GROUP BY 1",
    "supporting_groups": f"WITH {_NODES} SELECT parent, kind, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1, 2",
    "shared_neighbours": "SELECT l_partkey AS o, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
}
