"""Markdown corpora, query syntax, segments and answers over stand-ins from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import keyword as kw
from corpusloom.operators import query_syntax as qs
from corpusloom.operators import segments as sg
from corpusloom.operators import similarity as sim
from corpusloom.operators import tree as tr
from corpusloom.plans import sqltext as sq
from corpusloom.plans.keyword_queries import flat
from corpusloom.plans.similarity_queries import _dense, vectors
from corpusloom.plans.structure_queries import nodes
from corpusloom.session import table
from corpusloom.sources import markdown as md


def _uuid(key):
    return tx.hyphenated_uuid(F.md5(key))


def corpus(s, d):
    """Regions, nations and customers as numbered documents, suppliers as research that aims at their nation."""
    empty = F.array().cast("array<string>")
    n = F.col("n_nationkey") + 1
    nation = table(s, d, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") + 1).alias("r"))
    r = table(s, d, "region").select(F.concat(F.lit("A."), F.col("r_regionkey") + 1).alias("number"), F.col("r_name").alias("name"), F.lit("Scope").alias("kind"), F.lit("").alias("body"), empty.alias("targets"))
    a = nation.select(F.concat(F.lit("A."), "r", F.lit("."), n).alias("number"), F.col("n_name").alias("name"), F.lit("Article").alias("kind"), F.lit("An article.").alias("body"), empty.alias("targets"))
    c = table(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("A."), "r", F.lit("."), n, F.lit("."), F.col("c_custkey") + 1).alias("number"), F.col("c_name").alias("name"), F.lit("Core").alias("kind"), F.concat(F.lit("Segment **"), "c_mktsegment", F.lit("**\nkept.")).alias("body"), empty.alias("targets"))
    p = table(s, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("NR-"), F.col("s_suppkey") + 1).alias("number"), F.col("s_name").alias("name"), F.lit("Needed Research").alias("kind"), F.lit("Open.").alias("body"), F.array(_uuid(F.concat(F.lit("A."), "r", F.lit("."), n))).alias("targets"))
    rows = r.unionByName(a).unionByName(c).unionByName(p)
    return rows.select(_uuid(F.col("number")).alias("uuid"), "number", "name", "kind", "body", "targets")


def _monolith(s, d):
    """The composed corpus, a text a scope, as (path, text)."""
    rows = md.composed(corpus(s, d)).withColumn("path", F.when(F.col("kind") == md.RESEARCH, "NR").otherwise(F.substring_index("number", ".", 2)))
    entries = F.sort_array(F.collect_list(F.struct("position", "text")))
    return rows.groupBy("path").agg(F.array_join(F.transform(entries, lambda e: e["text"]), "\n").alias("text"))


def _segments(s, d):
    top = kw.search_all(flat(s, d), ["license"], 100).select(F.concat(F.lit("c"), "id").alias("id"), "rank")
    known = nodes(s, d)
    return sg.tree_segments(top.join(known.select("id"), "id", "left_semi"), tr.closure(known))


def _permutation(s, d):
    rows = _dense(s, d).filter("rank <= 80").join(vectors(s, d).select("id", "v", F.col("label").alias("segment")), "id")
    return sg.permuted(rows.select(F.col("query_id").alias("query"), "id", (F.col("rank") - 1).alias("rank"), "segment", "v"))


def _parsed_search(s, d):
    p = qs.parse('license type:EN in:src1 in:src2 in:src3 -warranty "apache license"')
    rows = flat(s, d)
    keep = rows.filter(qs.predicate(p, F.col("kind"), F.col("scope"), F.col("content"))).select("id")
    ranked = kw.scored(rows, ["license"]).join(keep, "id", "left_semi")
    return kw.top(ranked, 20).select("id", "rank")


def _definition(s, d):
    kind, subject = qs.question("What is the NATION_7?")
    assert kind == "definition"
    rows = corpus(s, d)
    found = rows.filter(tx.fold(F.col("name")) == subject.lower()).orderBy(F.length("number"), "number").limit(1)
    return found.select("number", tx.first_sentence(F.col("body")).alias("answer"))


QUERIES = {
    "markdown_compose": lambda s, d: md.composed(corpus(s, d)).select("position", "number", "level", F.md5("text").alias("digest")),
    "markdown_round_trip": lambda s, d: md.parsed_monolith(_monolith(s, d)).select("uuid", "number", "name", "kind", "level", "body"),
    "markdown_truncated": lambda s, d: md.truncated(corpus(s, d), 2).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "markdown_title_issues": lambda s, d: md.title_issues(_monolith(s, d), ["Scope", "Article", "Needed Research"]).groupBy("issue").agg(F.count(F.lit(1)).alias("n")),
    "heading_levels": lambda s, d: md.heading_levels(corpus(s, d)),
    "parents_by_number": lambda s, d: md.with_parents(corpus(s, d)).select("number", "parent_uuid"),
    "tree_segments": _segments,
    "segment_permutation": _permutation,
    "group_summaries": lambda s, d: sg.group_summaries(_permutation(s, d).join(vectors(s, d).select("id", F.col("label").alias("segment")), "id")).select("query", "segment", "first", F.size("hidden").alias("hidden")),
    "parsed_query_search": _parsed_search,
    "definition_answer": _definition,
    "excerpts": lambda s, d: table(s, d, "documents").select("doc_id", sg.excerpts(F.coalesce("text", F.lit("")), ["license", "copyright"]).alias("excerpt")),
    "snippets": lambda s, d: table(s, d, "documents").select("doc_id", tx.snippet(F.coalesce("text", F.lit("")), ["license"]).alias("snippet")),
    "highlights": lambda s, d: table(s, d, "benchmark").select("item_id", sg.highlighted(F.col("text"), r"(?i)\bthe\b").alias("html")),
    "same_body_sections": lambda s, d: sim.families(corpus(s, d).select(F.md5("body").alias("k"), "number"), "k", "number"),
    "json_fields": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")),
    "page_links": lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("links")),
    "conversation_turns": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role")),
    "neighbour_turns": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before")),
}

_U = "regexp_replace(md5({}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_N = "(SELECT 'A.' || (n_regionkey + 1) || '.' || (n_nationkey + 1) FROM nation WHERE n_nationkey = {})"
_CORPUS = f"""raw AS (SELECT 'A.' || (r_regionkey + 1) AS number, r_name AS name, 'Scope' AS kind, '' AS body, NULL AS target, 1 AS lv, [r_regionkey + 1, 0, 0, 0] AS k FROM region
UNION ALL SELECT 'A.' || (n_regionkey + 1) || '.' || (n_nationkey + 1), n_name, 'Article', 'An article.', NULL, 2, [n_regionkey + 1, n_nationkey + 1, 0, 0] FROM nation
UNION ALL SELECT 'A.' || (n_regionkey + 1) || '.' || (n_nationkey + 1) || '.' || (c_custkey + 1), c_name, 'Core', 'Segment **' || c_mktsegment || '**' || chr(10) || 'kept.', NULL, 3, [n_regionkey + 1, n_nationkey + 1, c_custkey + 1, 0] FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'NR-' || (s_suppkey + 1), s_name, 'Needed Research', 'Open.', 'A.' || (n_regionkey + 1) || '.' || (n_nationkey + 1), 3, [n_regionkey + 1, n_nationkey + 1, 0, 1] FROM supplier JOIN nation ON s_nationkey = n_nationkey),
corpus AS (SELECT {_U.format("number")} AS uuid, * FROM raw),
texts AS (SELECT *, CAST(row_number() OVER (ORDER BY k, number, uuid) AS INTEGER) AS position, repeat('#', lv) || ' ' || number || ' - ' || name || ' [' || kind || ']  <!-- UUID: ' || uuid || ' -->' || chr(10) || CASE WHEN body = '' THEN '' ELSE chr(10) || body || chr(10) END AS text FROM corpus)"""
_FOLDED = sq.fold("text")

SQL = {
    "markdown_compose": f"WITH {_CORPUS} SELECT position, number, lv AS level, md5(text) AS digest FROM texts",
    "markdown_round_trip": f"WITH {_CORPUS} SELECT uuid, number, name, kind, lv AS level, body FROM corpus",
    "markdown_truncated": f"WITH {_CORPUS} SELECT kind, count(*) AS n FROM corpus WHERE lv <= 2 GROUP BY kind",
    "markdown_title_issues": "SELECT issue, n FROM (SELECT 'kind' AS issue, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'level', (SELECT least(count(*), 1) FROM supplier)) WHERE n > 0",
    "heading_levels": f"WITH {_CORPUS} SELECT uuid, lv AS level FROM corpus",
    "parents_by_number": f"""WITH {_CORPUS} SELECT number, CASE WHEN target IS NOT NULL THEN {_U.format("target")} WHEN lv > 1 THEN {_U.format("regexp_replace(number, '[.][0-9]+$', '')")} END AS parent_uuid FROM corpus""",
    "tree_segments": f"""WITH RECURSIVE {sq.scored(["license"])}, top AS (SELECT 'c' || id AS id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE matched = 1 ORDER BY score DESC, id LIMIT 100),
t AS (SELECT id, rank FROM top JOIN customer ON id = 'c' || c_custkey), up AS (SELECT t.id, x.a, x.d FROM t JOIN customer ON t.id = 'c' || c_custkey JOIN nation ON c_nationkey = n_nationkey,
  LATERAL (SELECT unnest([t.id, 'n' || n_nationkey, 'r' || n_regionkey]) AS a, unnest([0, 1, 2]) AS d) x), sh AS (SELECT * FROM up QUALIFY count(*) OVER (PARTITION BY a) >= 2)
SELECT t.id, t.rank, coalesce((SELECT min_by(a, d) FROM sh WHERE sh.id = t.id), t.id) AS segment FROM t""",
    "parsed_query_search": f"""WITH {sq.scored(["license"])}, keep AS (SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')
  AND regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])apache license($|[^\\p{{L}}\\p{{N}}_])') AND NOT regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])warranty($|[^\\p{{L}}\\p{{N}}_])'))
SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE matched = 1 AND id IN (SELECT doc_id FROM keep) ORDER BY score DESC, id LIMIT 20""",
    "definition_answer": f"WITH {_CORPUS} SELECT number, body AS answer FROM corpus WHERE lower(name) = 'nation_7' ORDER BY length(number), number LIMIT 1",
    "snippets": f"SELECT doc_id, substr(text, greatest(CASE WHEN instr({_FOLDED}, 'license') > 0 THEN instr({_FOLDED}, 'license') ELSE 1 END - 50, 1), 150) AS snippet FROM documents",
    "highlights": r"SELECT item_id, regexp_replace(text, '(?i)\b(the)\b', '<mark>\1</mark>', 'g') AS html FROM benchmark",
    "same_body_sections": f"WITH {_CORPUS} SELECT md5(body) AS k, count(*) AS size, min(number) AS first FROM corpus GROUP BY 1 HAVING count(*) >= 2",
    "json_fields": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "page_links": """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""",
    "conversation_turns": "SELECT conv_id, count(*) AS turns, max_by(role, turn) AS last_role FROM conversations GROUP BY 1",
    "neighbour_turns": "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations",
}
