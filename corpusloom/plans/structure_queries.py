"""Graph, tree, version, evaluation, validation and stateful queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import evaluation as ev
from corpusloom.operators import graph as gr
from corpusloom.operators import quality as qa
from corpusloom.operators import tree as tr
from corpusloom.operators import versions as vs
from corpusloom.plans import sqltext as sq
from corpusloom.session import table
from corpusloom.staging import shared_folder
from corpusloom.streaming import stateful as st

ASKED = (1, 2, 3)


def postings(s, d):
    """Parts as entities, orders as sections, lines as mentions."""
    return table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("section")).agg(F.count(F.lit(1)).alias("count"))


def edges(s, d):
    """Suppliers deliver parts."""
    return table(s, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("r"), F.col("l_partkey").alias("o")).distinct()


def asked(s):
    return s.createDataFrame([(i,) for i in ASKED], "entity long")


def _hop(s, d):
    """Parts of the suppliers that return the asked parts."""
    near = gr.one_hop(edges(s, d), asked(s), ["R"]).withColumnRenamed("entity", "s")
    hopped = edges(s, d).filter("r = 'R'").join(F.broadcast(near), "s").select(F.col("o").alias("entity")).distinct()
    return gr.candidates(postings(s, d), gr.entity_weights(postings(s, d), asked(s), hopped))


def _ranked_orders(s, d):
    signal = postings(s, d).join(F.broadcast(asked(s)), "entity").groupBy(F.col("section").alias("id")).agg(F.sum("count").cast("double").alias("signal"))
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tier"), F.col("o_totalprice").alias("score"))
    from pyspark.sql import Window

    top = rows.orderBy("tier", F.desc("score"), "id").limit(2000).withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "id")))
    return gr.reranked(top.join(signal, "id", "left").withColumn("signal", F.coalesce("signal", F.lit(0.0))), "signal").select("id", "tier", "rank", "block", "position")


def _related(s, d):
    """Orders related to order 1: same customer, then shared parts."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("section"), F.col("o_custkey").alias("c"), F.round("o_totalprice", 2).alias("strength"))
    me = o.filter("section = 1").select("c")
    own = postings(s, d).filter("section = 1").select("entity")
    same = o.join(F.broadcast(me), "c").filter("section <> 1").select("section", "strength")
    shared = postings(s, d).join(F.broadcast(own), "entity").filter("section <> 1").groupBy("section").agg(F.sum("count").cast("double").alias("strength"))
    return gr.related([same, shared])


def _aliases(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name"), " ").alias("words"))
    names = table(s, d, "part").select(F.col("p_name").alias("alias")).distinct().withColumn("entity", F.concat(F.lit("name:"), "alias"))
    words = table(s, d, "part").select(F.split("p_name", " ")[0].alias("alias")).distinct().withColumn("entity", F.concat(F.lit("word:"), "alias"))
    return gr.longest_aliases(rows, names.unionByName(words))


def nodes(s, d):
    r = table(s, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ord"), F.lit("region").alias("kind"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"), F.lit("nation").alias("kind"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"), F.lit("customer").alias("kind"))
    p = table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"), F.lit("supplier").alias("kind"))
    return r.unionByName(n).unionByName(c).unionByName(p)


def numbers(s, d):
    """Dotted numbers with gaps: brand, size, key."""
    return table(s, d, "part").select(F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), F.when(F.col("p_size") % 3 == 0, F.lit("N")).otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey").cast("string"))).alias("number")).distinct()


def results(s, d):
    """Customers of one segment, with their paths."""
    chosen = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    return tr.paths(nodes(s, d)).join(chosen, "id", "left_semi")


def versions(s, d):
    """Two versions of the orders: some gone, some new, some with another body, name or number."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("number"), F.col("o_orderpriority").alias("name"),
                                     F.concat(F.lit("see [A."), "o_custkey", F.lit(" - "), "o_orderstatus", F.lit("] total "), F.col("o_orderstatus")).alias("body"))
    k = F.pmod(F.col("id") * 31, F.lit(97))
    base = o.filter(k != 1)
    head = o.filter(k != 2).withColumn("body", F.when(k == 3, F.concat("body", F.lit(" more"))).when(k == 4, F.regexp_replace("body", r"A\.", "B.")).otherwise(F.col("body"))).withColumn("number", F.when(k.isin(4, 5), F.concat("number", F.lit("x"))).otherwise(F.col("number")))
    return base, head


def node_versions(s, d):
    n = nodes(s, d).withColumn("k", F.pmod(F.col("ord") * 7, F.lit(11)))
    return n, n.filter(~((F.col("kind").isin("nation", "customer")) & (F.col("k") == 3)))


def _living(s, d):
    base, head = node_versions(s, d)
    removed = base.join(head.select("id"), "id", "left_anti")
    return vs.nearest_living(removed, tr.closure(base), head)


def _scope_roots(s, d):
    base, head = node_versions(s, d)
    return vs.scope_roots(base.join(head.select("id"), "id", "left_anti").select("id"), tr.closure(base))


def _word_diff(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("old"), F.regexp_replace("text", r"\bthe\b", "a").alias("new"))
    return vs.word_diff(docs).drop("html")


def _lines(s, d):
    """Each page as a line range in one file, and every 50th line as changed."""
    p = table(s, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") * 7).alias("line_start"), (F.col("page_id") * 7 + 4).alias("line_end"))
    return vs.touched(p, s.range(1, 400).select((F.col("id") * 50).alias("first"), (F.col("id") * 50 + 1).alias("last")))


def judged(s, d):
    """Queries are sources; grades are the labels; the ranking is by length."""
    from pyspark.sql import Window

    docs = table(s, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), "n_chars")
    rankings = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc"))).select("query", "rank", "doc")
    grade = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 2).otherwise(1)
    judgments = table(s, d, "labels").select(F.col("doc_id").alias("doc"), grade.alias("grade")).join(docs.select("query", "doc"), "doc").withColumn("unit", F.col("doc"))
    return rankings, judgments


def _by_class(s, d):
    scores = ev.exact_metrics(*judged(s, d)).withColumn("class", F.length("query"))
    return ev.summaries(scores, "class").select(F.coalesce("class", F.lit(-1)).alias("class"), "ndcg10", "mrr", "n")


def _bootstrap(s, d):
    from pyspark.sql import Window

    rankings, judgments = judged(s, d)
    other = rankings.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc")))
    got = ev.paired_bootstrap(ev.metrics(other, judgments), ev.metrics(rankings, judgments), "ndcg10")
    return got.select("metric", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def events(s, d):
    return table(s, d, "events").select("event_id", "ts", F.col("user_id").alias("client"), "event_type", "value")


def _stream(s, d):
    """The windowed counts as a stream that is drained into the shared folder and read back."""
    source = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    base = f"{shared_folder(s)}/corpusloom/stream-{uuid.uuid4().hex}"

    counts = source.groupBy(F.window("ts", "60 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{base}/out"))
    query.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    return s.read.parquet(f"{base}/out")


def _quotes(s, d):
    claims = table(s, d, "benchmark").select(F.col("item_id").alias("claim"), F.col("item_id").alias("doc"), tx.first_sentence(F.col("text")).alias("quote"))
    return qa.verified(claims, table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


def _leaks(s, d):
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("made"), F.left("text", F.lit(1000)).alias("source"))
    return qa.number_leaks(rows, "made", "source").select("doc_id", F.size("leaks").alias("n"), F.array_join(F.array_sort("leaks"), "|").alias("leaks"))


def _changes(s, d):
    return vs.classified(*versions(s, d))


QUERIES = {
    "entity_candidates": lambda s, d: gr.candidates(postings(s, d), gr.entity_weights(postings(s, d), asked(s))),
    "entity_candidates_hop": _hop,
    "within_tier_rerank": _ranked_orders,
    "co_mentions": lambda s, d: gr.co_mentions(postings(s, d)),
    "cites_both_directions": lambda s, d: gr.both_directions(table(s, d, "orders").select(F.col("o_orderkey").alias("s"), F.col("o_custkey").alias("o"))),
    "related_documents": _related,
    "alias_longest_match": _aliases,
    "relation_match": lambda s, d: gr.relation_matches(table(s, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.sort_array(F.collect_set(F.split("p_name", " ")[1])).alias("stems")).withColumn("stems", F.slice("stems", 1, 2)), ["anvil", "bolt", "nut"]),
    "triple_answer": lambda s, d: gr.triple_answers(table(s, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("r"), F.col("l_partkey").alias("o")), 5, F.col("r").isin("A", "R")),
    "tree_flatten": lambda s, d: tr.flattened(nodes(s, d)),
    "ancestors": lambda s, d: tr.closure(nodes(s, d)),
    "children_count": lambda s, d: tr.children_count(nodes(s, d)),
    "subtree_filter": lambda s, d: tr.subtree(nodes(s, d), F.col("name") == "ASIA"),
    "nearest_existing_ancestor": lambda s, d: tr.nearest_existing(numbers(s, d)),
    "scope_chips": lambda s, d: tr.scope_chips(results(s, d)),
    "distinguishing_segments": lambda s, d: tr.distinguishing(results(s, d)),
    "mini_tree": lambda s, d: tr.mini_tree(nodes(s, d), "n7"),
    "natural_order": lambda s, d: _natural(s, d),
    "canonical_order": lambda s, d: tr.canonical_order(numbers(s, d)),
    "version_classify": _changes,
    "version_stats": lambda s, d: vs.stats(_changes(s, d)),
    "scope_roots": _scope_roots,
    "deleted_nearest_ancestor": _living,
    "line_range_overlap": _lines,
    "word_diff": _word_diff,
    "ndcg_mrr_recall": lambda s, d: ev.metrics(*judged(s, d)),
    "metrics_by_class": _by_class,
    "nearest_rank_percentile": lambda s, d: ev.nearest_rank(table(s, d, "documents").select("source", "n_chars"), "source", "n_chars", 0.95),
    "paired_bootstrap": _bootstrap,
    "artifact_freshness": lambda s, d: table(s, d, "pages").select("page_id", ev.freshness(F.when(F.col("page_id") % 3 == 0, F.md5("html")).when(F.col("page_id") % 3 == 1, F.md5("url")), F.md5("html")).alias("state")),
    "validate_ids": lambda s, d: qa.bad_ids(table(s, d, "supplier").withColumn("key", F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.col("s_name"))), "key", r"^Supplier#\d*[02468]$").select("s_suppkey", "issue"),
    "validate_duplicates": lambda s, d: qa.duplicate_ids(table(s, d, "documents").withColumn("key", F.md5("text")), "key", "doc_id"),
    "validate_nesting": lambda s, d: qa.bad_nesting(nodes(s, d).join(nodes(s, d).select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind")), "parent"), s.createDataFrame([("region", "nation"), ("nation", "customer")], "parent_kind string, kind string")).select("id", "kind", "parent_kind"),
    "validate_order": lambda s, d: qa.order_gaps(table(s, d, "conversations").filter("role <> 'user'").select("conv_id", "turn"), "conv_id", "turn").select("conv_id", "turn", "before"),
    "completeness_by_type": lambda s, d: qa.completeness(table(s, d, "documents").select("lang"), table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_semi").select("lang"), "lang"),
    "verify_quotes": _quotes,
    "number_leaks": _leaks,
    "count_answer": lambda s, d: qa.count_answer(nodes(s, d), ["nation", "7"]),
    "rate_limit_fixed_window": lambda s, d: st.windowed_limits(events(s, d), 1, 3600),
    "events_window": lambda s, d: st.windowed_counts(events(s, d)),
    "events_stream_window": _stream,
    "latest_per_user": lambda s, d: st.latest(events(s, d), "client", ["ts", "event_id"], "event_type"),
    "recent_distinct": lambda s, d: st.recent_distinct(events(s, d), "client", "event_type", ["ts", "event_id"], 3),
    "latency_ring": lambda s, d: st.ring(events(s, d), "event_type", ["ts", "event_id"], 50).select("event_type", "event_id"),
    "hash_incremental": lambda s, d: st.stale(table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), table(s, d, "documents").select("doc_id", F.sha2(F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("!"))), 256).alias("h")), "doc_id", "h"),
}


def _natural(s, d):
    from pyspark.sql import Window

    n = numbers(s, d)
    return n.withColumn("key", tr.natural_key(F.col("number"))).withColumn("position", F.row_number().over(Window.orderBy("key", "number"))).select("number", "position")


_POST = "p AS (SELECT l_partkey AS entity, l_orderkey AS section, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT entity, count(*) AS mentions FROM p GROUP BY 1)"
_EDGE = "e AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS r, l_partkey AS o FROM lineitem)"
_CAND = "SELECT section, count(*) FILTER (direct) AS coverage, round(sum(w * log2(1 + n)), 6) AS score FROM p JOIN w USING (entity) GROUP BY section ORDER BY coverage DESC, score DESC, section LIMIT 20"
_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name, CAST(r_regionkey AS BIGINT) AS ord, 'region' AS kind FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey, 'customer' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, s_suppkey, 'supplier' FROM supplier)"""
_CLO = f"{_NODES}, clo(id, ancestor, distance) AS (SELECT id, id, 0 FROM nodes UNION ALL SELECT c.id, n.parent, c.distance + 1 FROM clo c JOIN nodes n ON c.ancestor = n.id WHERE n.parent IS NOT NULL)"
_RES = f"{_CLO}, res AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), steps AS (SELECT c.id, c.ancestor AS seg, (SELECT max(distance) FROM clo x WHERE x.id = c.id) - c.distance AS level FROM clo c JOIN res USING (id))"
_NUM = "num AS (SELECT DISTINCT concat_ws('.', regexp_extract(p_brand, '([0-9]+)', 1), CASE WHEN p_size % 3 = 0 THEN 'N' ELSE CAST(p_size AS VARCHAR) END, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey AS VARCHAR) END) AS number FROM part)"
_VERS = r"""o AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS number, o_orderpriority AS name, 'see [A.' || o_custkey || ' - ' || o_orderstatus || '] total ' || o_orderstatus AS body, o_orderkey * 31 % 97 AS k FROM orders),
base AS (SELECT * FROM o WHERE k <> 1), head AS (SELECT id, CASE WHEN k IN (4, 5) THEN number || 'x' ELSE number END AS number, name, CASE k WHEN 3 THEN body || ' more' WHEN 4 THEN replace(body, 'A.', 'B.') ELSE body END AS body FROM o WHERE k <> 2),
ch AS (SELECT * FROM (SELECT coalesce(h.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN h.id IS NULL THEN 'removed' WHEN h.body = b.body AND h.name = b.name THEN NULL
  WHEN h.name = b.name AND regexp_replace(h.body, '\[[A-Z]?[0-9.]+ - ([^\]]+)\]', '[\1]', 'g') = regexp_replace(b.body, '\[[A-Z]?[0-9.]+ - ([^\]]+)\]', '[\1]', 'g') THEN 'renumbered' ELSE 'modified' END AS status
  FROM head h FULL JOIN base b ON h.id = b.id) WHERE status IS NOT NULL)"""
_GONE = f"{_CLO}, gone AS (SELECT id FROM nodes WHERE kind IN ('nation', 'customer') AND ord * 7 % 11 = 3)"
_JUDGED = """r AS (SELECT source AS query, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
j AS (SELECT source AS query, l.doc_id AS doc, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 2 ELSE 1 END AS grade FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
got AS (SELECT query, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, 1.0::DOUBLE / min(rank) AS mrr, count(*) FILTER (rank <= 10) AS f10, count(*) FILTER (rank <= 50) AS f50 FROM r JOIN j USING (query, doc) WHERE grade > 0 GROUP BY query),
best AS (SELECT query, sum(CASE WHEN p <= 10 THEN (pow(2, grade) - 1) / log2(p + 1) ELSE 0 END) AS ideal, count(*) AS units FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS p FROM j WHERE grade > 0) GROUP BY query),
exact AS (SELECT q.query, CASE WHEN coalesce(ideal, 0) = 0 THEN 0 ELSE coalesce(dcg, 0) / ideal END AS ndcg10, coalesce(mrr, 0) AS mrr,
  CASE WHEN coalesce(units, 0) = 0 THEN 1 ELSE coalesce(f10, 0) / units::DOUBLE END AS recall10, CASE WHEN coalesce(units, 0) = 0 THEN 1 ELSE coalesce(f50, 0) / units::DOUBLE END AS recall50
  FROM (SELECT DISTINCT query FROM j) q LEFT JOIN best USING (query) LEFT JOIN got USING (query)),
met AS (SELECT query, round(ndcg10, 6) AS ndcg10, round(mrr, 6) AS mrr, round(recall10, 6) AS recall10, round(recall50, 6) AS recall50 FROM exact)"""
_WINDOWS = "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
_SENT = r"left(CASE WHEN regexp_matches(trim(b.text), '(?s)^.*?[.!?](\s|$)') THEN regexp_extract(trim(b.text), '(?s)^(.*?[.!?])(?:\s|$)', 1) ELSE trim(b.text) END, 220)"
_QUOTE = r'''trim(regexp_replace(translate(lower(coalesce({}, '')), '‘’“”', chr(39) || chr(39) || '""'), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))'''

SQL = {
    "entity_candidates": f"WITH {_POST}, w AS (SELECT entity, 1 / log2(2 + mentions) AS w, true AS direct FROM m WHERE entity IN {ASKED}) {_CAND}",
    "entity_candidates_hop": f"""WITH {_POST}, {_EDGE}, hop AS (SELECT DISTINCT o AS entity FROM e WHERE r = 'R' AND s IN (SELECT s FROM e WHERE r = 'R' AND o IN {ASKED})),
w AS (SELECT entity, 1 / log2(2 + mentions) * CASE WHEN entity IN {ASKED} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w, entity IN {ASKED} AS direct FROM m WHERE entity IN {ASKED} OR entity IN (SELECT entity FROM hop)) {_CAND}""",
    "within_tier_rerank": f"""WITH {_POST}, sig AS (SELECT section AS id, sum(n)::DOUBLE AS signal FROM p WHERE entity IN {ASKED} GROUP BY 1),
r AS (SELECT o_orderkey AS id, o_orderpriority AS tier, o_totalprice AS score, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY 2, 3 DESC, 1 LIMIT 2000),
x AS (SELECT r.*, coalesce(signal, 0) AS signal, dense_rank() OVER (ORDER BY tier) AS block FROM r LEFT JOIN sig USING (id)),
y AS (SELECT *, max(signal) OVER (PARTITION BY block) AS mx FROM x)
SELECT id, tier, CAST(rank AS INTEGER) AS rank, block, CAST(row_number() OVER (ORDER BY block, round(score * (1 + CASE WHEN mx > 0 THEN 0.5::DOUBLE * signal / mx ELSE 0 END), 9) DESC, rank) AS INTEGER) AS position FROM y""",
    "co_mentions": f"WITH {_POST} SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM p a JOIN p b ON a.section = b.section AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2",
    "cites_both_directions": "SELECT o_orderkey AS node, o_custkey AS other, 'cites' AS direction FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'cited_by' FROM orders",
    "related_documents": f"""WITH {_POST}, a AS (SELECT o_orderkey AS section, 0 AS reason, round(o_totalprice, 2) AS strength FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 1) AND o_orderkey <> 1
UNION ALL SELECT section, 1, sum(n)::DOUBLE FROM p WHERE section <> 1 AND entity IN (SELECT entity FROM p WHERE section = 1) GROUP BY section),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY section ORDER BY reason, strength DESC) = 1)
SELECT section, reason, strength, CAST(row_number() OVER (ORDER BY reason, strength DESC, section) AS INTEGER) AS place FROM b ORDER BY reason, strength DESC, section LIMIT 8""",
    "relation_match": "WITH x AS (SELECT p_type AS name, list_sort(list_distinct(list(string_split(p_name, ' ')[2])))[1:2] AS stems FROM part GROUP BY 1) SELECT name FROM x WHERE name <> 'related_to' AND len(list_filter(stems, lambda t: NOT list_contains(['anvil', 'bolt', 'nut'], t))) = 0",
    "triple_answer": "SELECT l_returnflag AS r, l_partkey AS o, count(*) AS evidence FROM lineitem WHERE l_suppkey = 5 AND l_returnflag IN ('A', 'R') GROUP BY 1, 2 ORDER BY evidence DESC, r, o LIMIT 6",
    "tree_flatten": f"""WITH RECURSIVE {_NODES}, t AS (SELECT id, parent, 0 AS depth, [{{'o': ord, 'i': id}}] AS key FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, n.parent, t.depth + 1, list_append(t.key, {{'o': n.ord, 'i': n.id}}) FROM nodes n JOIN t ON n.parent = t.id)
SELECT id, parent, depth, CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS position FROM t""",
    "ancestors": f"WITH RECURSIVE {_CLO} SELECT id, ancestor, distance FROM clo",
    "children_count": f"WITH {_NODES} SELECT parent, count(*) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY 1",
    "subtree_filter": f"WITH RECURSIVE {_CLO} SELECT DISTINCT id FROM clo WHERE ancestor IN (SELECT id FROM nodes WHERE name = 'ASIA')",
    "nearest_existing_ancestor": f"WITH {_NUM} SELECT n.number, max_by(p.number, length(p.number)) AS parent FROM num n LEFT JOIN num p ON starts_with(n.number, p.number || '.') GROUP BY n.number",
    "scope_chips": f"WITH RECURSIVE {_RES}, c AS (SELECT seg AS node, count(DISTINCT id) AS covered FROM steps GROUP BY 1), t AS (SELECT count(*) AS total FROM res) SELECT node, covered FROM c, t WHERE covered < total ORDER BY abs(total / 2.0::DOUBLE - covered), node LIMIT 6",
    "distinguishing_segments": f"""WITH RECURSIVE {_RES}, n AS (SELECT *, count(*) OVER (PARTITION BY level, seg) AS n FROM steps), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n, level DESC) <= 2)
SELECT id, string_agg(seg, ' > ' ORDER BY level) AS label FROM k GROUP BY id""",
    "mini_tree": f"""WITH {_NODES}, sib AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE parent = (SELECT parent FROM nodes WHERE id = 'n7')),
f AS (SELECT greatest(0, least(i - 2, n - 5)) AS first, n FROM sib WHERE id = 'n7') SELECT id, CAST(i AS INTEGER) AS i, first AS hidden_before, greatest(0, f.n - first - 5) AS hidden_after FROM sib, f WHERE i >= first AND i < first + 5""",
    "natural_order": f"""WITH {_NUM}, k AS (SELECT number, list_transform(string_split(number, '.'), lambda c: {{'t': CASE WHEN regexp_full_match(c, '[0-9]+') THEN 0 ELSE 1 END, 'n': coalesce(TRY_CAST(c AS BIGINT), 0), 'c': c}}) AS key FROM num)
SELECT number, CAST(row_number() OVER (ORDER BY key, number) AS INTEGER) AS position FROM k""",
    "canonical_order": f"""WITH {_NUM}, st AS (SELECT number, string_split(number, '.') AS parts, unnest(range(1, len(string_split(number, '.')) + 1)) AS level FROM num),
x AS (SELECT number, level, parts[level] AS seg, array_to_string(parts[1:level], '.') AS prefix FROM st),
y AS (SELECT number, level, {{'k': CASE WHEN NOT regexp_full_match(seg, '[0-9]+') AND level > 1 THEN 2 WHEN prefix IN (SELECT number FROM num) THEN 0 ELSE 1 END, 'n': coalesce(TRY_CAST(seg AS BIGINT), 0), 's': seg}} AS e FROM x),
z AS (SELECT number, list(e ORDER BY level) AS key FROM y GROUP BY number) SELECT number, CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS position FROM z""",
    "version_classify": f"WITH {_VERS} SELECT id, status FROM ch",
    "version_stats": f"WITH {_VERS} SELECT count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'renumbered') AS renumbered, count(*) AS total FROM ch",
    "scope_roots": f"WITH RECURSIVE {_GONE} SELECT id FROM gone WHERE id NOT IN (SELECT id FROM clo WHERE distance > 0 AND ancestor IN (SELECT id FROM gone))",
    "deleted_nearest_ancestor": f"WITH RECURSIVE {_GONE} SELECT g.id, min_by(c.ancestor, c.distance) AS living FROM gone g LEFT JOIN clo c ON c.id = g.id AND c.ancestor NOT IN (SELECT id FROM gone) GROUP BY g.id",
    "line_range_overlap": "SELECT page_id AS id FROM pages WHERE EXISTS (SELECT 1 FROM range(1, 400) r(k) WHERE page_id * 7 <= k * 50 + 1 AND k * 50 <= page_id * 7 + 4)",
    "ndcg_mrr_recall": f"WITH {_JUDGED} SELECT * FROM met",
    "metrics_by_class": f"WITH {_JUDGED} SELECT CAST(coalesce(length(query), -1) AS INTEGER) AS class, round(CAST(sum(CAST(ndcg10 AS DECIMAL(20, 12))) AS DOUBLE) / count(*), 6) AS ndcg10, round(CAST(sum(CAST(mrr AS DECIMAL(20, 12))) AS DOUBLE) / count(*), 6) AS mrr, count(*) AS n FROM exact GROUP BY GROUPING SETS ((length(query)), ())",
    "nearest_rank_percentile": "SELECT source, n_chars AS value FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r = greatest(1, ceil(0.95::DOUBLE * n))",
    "artifact_freshness": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN CASE WHEN md5(url) = md5(html) THEN 'fresh' ELSE 'stale' END ELSE 'missing' END AS state FROM pages",
    "validate_ids": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'empty' WHEN 2 THEN 'missing' ELSE 'format' END AS issue FROM supplier WHERE s_suppkey % 3 <> 1 OR NOT regexp_matches(s_name, '^Supplier#[0-9]*[02468]$')",
    "validate_duplicates": "SELECT md5(text) AS key, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "validate_nesting": f"WITH {_NODES} SELECT c.id, c.kind, p.kind AS parent_kind FROM nodes c JOIN nodes p ON c.parent = p.id WHERE (p.kind, c.kind) NOT IN (('region', 'nation'), ('nation', 'customer'))",
    "validate_order": "SELECT conv_id, turn, before FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role <> 'user') WHERE turn - coalesce(before, turn - 1) <> 1",
    "completeness_by_type": "SELECT lang, expected, found FROM (SELECT lang, count(*) AS expected, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS found FROM documents GROUP BY lang) WHERE expected <> found",
    "verify_quotes": f"SELECT item_id AS claim, item_id AS doc, length({_QUOTE.format(_SENT)}) >= 15 AND coalesce(contains({_QUOTE.format('d.text')}, {_QUOTE.format(_SENT)}), false) AS faithful FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id",
    "number_leaks": r"""WITH n AS (SELECT doc_id, left(text, 1000) AS source, list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS nums FROM documents), l AS (SELECT doc_id, list_filter(nums, lambda x: NOT contains(source, x)) AS leaks FROM n)
SELECT doc_id, CAST(len(leaks) AS INTEGER) AS n, array_to_string(list_sort(leaks), '|') AS leaks FROM l WHERE len(leaks) > 0""",
    "count_answer": f"WITH {_NODES}, c AS (SELECT parent AS id, count(*) AS children FROM nodes GROUP BY 1) SELECT n.id, n.name, c.children FROM nodes n JOIN c USING (id) WHERE list_has_all(regexp_split_to_array(lower(name), '[^a-z0-9]+'), ['nation', '7']) ORDER BY length(name), children DESC, n.id LIMIT 1",
    "rate_limit_fixed_window": "SELECT user_id AS client, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, count(*) AS requests, greatest(0, count(*) - 1) AS rejected FROM events GROUP BY 1, 2",
    "events_window": _WINDOWS,
    "events_stream_window": _WINDOWS,
    "latest_per_user": "SELECT user_id AS client, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "recent_distinct": "SELECT client, event_type, CAST(place AS INTEGER) AS place FROM (SELECT user_id AS client, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max((ts, event_id)) DESC, event_type) AS place FROM events GROUP BY 1, 2) WHERE place <= 3",
    "latency_ring": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50",
    "hash_incremental": "SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'en' OR lang IS NULL",
}
