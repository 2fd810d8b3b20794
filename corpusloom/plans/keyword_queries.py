"""Keyword retrieval over the driver's documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fulltext as ft
from corpusloom.operators import keyword as kw
from corpusloom.plans import sqltext as sq
from corpusloom.session import table
from corpusloom.staging import new_place

TERMS = ["apache", "license"]
LOOSE = ["apache", "general", "public"]


def flat(spark, d):
    return kw.flat_documents(table(spark, d, "documents"))


def _docs(spark, d):
    return table(spark, d, "documents")


QUERIES = {
    "keyword_and_topk": lambda s, d: kw.search_all(flat(s, d), TERMS, 10),
    "keyword_or_relaxed_tiers": lambda s, d: kw.tiers(flat(s, d), LOOSE, 50),
    "keyword_field_restricted": lambda s, d: kw.search_all(flat(s, d), ["ertion"], 20, fields=("name",)),
    "keyword_typed_filter": lambda s, d: kw.search_all(flat(s, d), TERMS, 20, where=F.lower("kind").isin("fr", "de")),
    "keyword_prefix": lambda s, d: kw.expand_prefix(kw.vocabulary(flat(s, d)), "licens").select("term", "df", F.round("weight", 6).alias("weight")),
    "keyword_fuzzy_guarded": lambda s, d: kw.expand_fuzzy(kw.vocabulary(flat(s, d)), "licence").select("term", "df", "distance", F.round("weight", 6).alias("weight")),
    "promoted_target": lambda s, d: _promoted(s, d),
    "abbreviation_companion": lambda s, d: kw.expanded_tier(flat(s, d), ["gpl"], {"gpl": ["general", "public", "license"]}, 20),
    "index_search": lambda s, d: _index_search(s, d),
    "stemmed_search": lambda s, d: _stemmed(s, d),
    "phrase_exclude_filter": lambda s, d: flat(s, d).filter(kw.phrase_filter(F.col("content"), ["apache license"], ["Version 2"], ["warranty"])).select("id", "kind"),
    "browse_filter_only": lambda s, d: _browse(s, d),
    "id_prefix_jump": lambda s, d: table(s, d, "pages").withColumn("key", F.md5(F.col("url"))).filter(F.col("key").startswith("a")).orderBy("page_id").limit(1).select("page_id", "url", "key"),
    "document_frequency": lambda s, d: kw.vocabulary(flat(s, d)),
    "title_keyword_counts": lambda s, d: kw.title_keywords(flat(s, d)),
    "title_cooccurrence": lambda s, d: kw.suggest_titles(flat(s, d), ["ertion"], "th"),
    "inherited_keywords": lambda s, d: _inherited(s, d),
    "abbreviation_harvest": lambda s, d: kw.harvested_abbreviations(_with_definitions(s, d)),
    "collision_dropped_aliases": lambda s, d: kw.unambiguous(table(s, d, "part").select(F.split("p_name", " ")[0].alias("alias"), F.col("p_brand").alias("owner")).unionByName(table(s, d, "supplier").select(F.lower("s_name").alias("alias"), F.col("s_name").alias("owner"))), "alias", "owner"),
    "match_evidence": lambda s, d: kw.match_evidence(flat(s, d), "licensed"),
    "term_coverage": lambda s, d: kw.coverage(flat(s, d), ["apache", "license", "version", "public"]),
    "exact_window": lambda s, d: kw.exact_window(flat(s, d), ["license", "version"]),
    "section_page_caps": lambda s, d: kw.paged_sections(kw.scored(flat(s, d), LOOSE), F.when(F.col("matched") == 3, "exact").when(F.col("matched") == 2, "similar").otherwise("partial")).select("id", "section", "place", "section_total", "score"),
    "diversity_interleave": lambda s, d: kw.interleaved(kw.search_all(flat(s, d), ["license"], 40), "scope").select("id", "scope", "rank", "wave", "position"),
    "title_priority": lambda s, d: _title_priority(s, d),
    "strict_count_probe": lambda s, d: kw.scored(flat(s, d), TERMS).filter(F.col("matched") == len(TERMS)).agg(F.count(F.lit(1)).alias("n")),
    "weak_split": lambda s, d: _weak(s, d),
    "fold_accents": lambda s, d: _docs(s, d).select("doc_id", tx.fold(tx.first_line(F.col("text"))).alias("folded")),
    "tokens": lambda s, d: _docs(s, d).select("doc_id", F.size(tx.raw_tokens(F.col("text"))).alias("n"), F.md5(F.array_join(tx.raw_tokens(F.col("text")), " ")).alias("digest")),
    "compound_pieces": lambda s, d: _docs(s, d).select("doc_id", F.explode(tx.raw_tokens(F.col("text"))).alias("token")).filter(F.instr("token", "-") > 0).select("doc_id", "token", F.array_join(tx.compound_pieces(F.col("token")), "|").alias("pieces")),
    "shingles": lambda s, d: _docs(s, d).select("doc_id", tx.shingles(tx.words(F.col("text"))).alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest")),
    "identifier_tokens": lambda s, d: _docs(s, d).select("doc_id", F.explode(tx.raw_tokens(F.col("text"))).alias("token")).filter(tx.is_identifier(F.col("token"))),
    "first_sentences": lambda s, d: _docs(s, d).select("doc_id", tx.first_sentence(F.col("text")).alias("sentence")),
    "slugs": lambda s, d: table(s, d, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug")),
    "stop_word_share": lambda s, d: _docs(s, d).select("doc_id", F.size(F.filter(tx.raw_tokens(F.col("text")), tx.is_stop_word)).alias("stops"), F.size(tx.raw_tokens(F.col("text"))).alias("tokens")),
    "postings_index": lambda s, d: kw.postings(flat(s, d)).groupBy("field").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("occurrences")),
}


def _promoted(s, d):
    ranked = kw.search_all(flat(s, d), ["license"], 60).select("id", "score", "rank")
    last = ranked.agg(F.max("id")).head()[0]
    return kw.promoted(ranked, last, 10)


def _index_search(s, d):
    """A search with stems, a prefix and typos from an index that is written first; the stemmer has no SQL form."""
    path = new_place(s, "index")
    ft.write_index(flat(s, d), path)
    return ft.Index(s, path).search("licensing of publik software", 50)


def _stemmed(s, d):
    """Documents that hold a word with the stem of the query's word."""
    return ft.word_forms(flat(s, d), "licensing")


def _browse(s, d):
    rows = flat(s, d).filter((F.lower("kind") == "de") & F.col("scope").isin("src1", "src2")).select("id", "name")
    return rows.orderBy("id").limit(100)


def _names(s, d):
    """Region, nation and customer as one tree of names."""
    r = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


def _inherited(s, d):
    from corpusloom.operators.tree import closure

    nodes = _names(s, d)
    return kw.inherited_terms(nodes, closure(nodes), 50)


def _with_definitions(s, d):
    """Part names in capitals with their initials in brackets after them: a corpus that defines abbreviations."""
    words = F.split(F.initcap("p_name"), " ")
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("The "), F.array_join(words, " "), F.lit(" ("), initials, F.lit(") applies.")).alias("content"))


def _title_priority(s, d):
    ranked = kw.search_all(flat(s, d), ["license"], 40).join(flat(s, d).select("id", "name"), "id")
    first = ranked.orderBy(F.desc("rank")).select("name").head()
    return kw.title_first(ranked, first.name if first else "").select("id", "rank", "position")


def _weak(s, d):
    rows = kw.search_all(flat(s, d), ["license"], 100)
    best = F.max("score").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("weak", F.round(F.col("score") / best, 6) < 0.6).select("id", "rank", "weak")


def _top(terms, n, where="true", fields=("name", "content")):
    cond = f"matched = {len(terms)} AND {where}"
    return f"WITH {sq.scored(terms, fields, cond)} SELECT id, kind, scope, depth, score, matched, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, id LIMIT {n}"


_VOCAB = f"{sq.FLAT}, vocab AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(list_concat(t_name, t_content))) AS term FROM flat) GROUP BY term)"
_LICENSE = f"SELECT id, scope, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE matched = 1 ORDER BY score DESC, id"
_RAW = sq.raw_tokens("text")
_WORDS = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' '), ' '), lambda w: w <> '')"

SQL = {
    "keyword_and_topk": _top(TERMS, 10),
    "keyword_or_relaxed_tiers": f"""WITH {sq.scored(LOOSE)},
tiered AS (SELECT *, CASE WHEN matched = 3 THEN 0 ELSE 1 END AS tier FROM scored),
gate AS (SELECT count(*) AS n FROM tiered WHERE tier = 0)
SELECT id, kind, scope, depth, score, matched, tier, CAST(row_number() OVER (ORDER BY tier, score DESC, id) AS INTEGER) AS rank
FROM tiered, gate WHERE tier = 0 OR n < 50 ORDER BY tier, score DESC, id LIMIT 50""",
    "keyword_field_restricted": _top(["ertion"], 20, fields=("name",)),
    "keyword_typed_filter": _top(TERMS, 20, "lower(kind) IN ('fr', 'de')"),
    "keyword_prefix": f"""WITH {_VOCAB} SELECT term, df, round(CASE WHEN length(term) = 6 THEN 1.0::DOUBLE ELSE 0.375::DOUBLE * length(term) / (length(term) + 0.3::DOUBLE * (length(term) - 6)) END, 6) AS weight
FROM vocab WHERE starts_with(term, 'licens')""",
    "keyword_fuzzy_guarded": f"""WITH {_VOCAB}, near AS (SELECT term, df, CAST(levenshtein(term, 'licence') AS INTEGER) AS distance FROM vocab WHERE abs(length(term) - 7) <= 1 AND levenshtein(term, 'licence') <= 1)
SELECT term, df, distance, round(CASE WHEN distance = 0 THEN 1.0::DOUBLE ELSE 0.45::DOUBLE * length(term) / (length(term) + distance) END, 6) AS weight
FROM near WHERE distance = 0 OR NOT EXISTS (SELECT 1 FROM near WHERE distance = 0)""",
    "promoted_target": f"""WITH {sq.scored(["license"])}, ranked AS ({_LICENSE} LIMIT 60), target AS (SELECT max(id) AS t FROM ranked)
SELECT id, score, CAST(row_number() OVER (ORDER BY CASE WHEN id = t THEN least(rank, 10) - 0.5 ELSE rank END) AS INTEGER) AS rank FROM ranked, target""",
    "abbreviation_companion": f"""WITH {sq.scored(["general", "public", "license"])}, strict AS (SELECT id FROM flat WHERE list_contains(t_name, 'gpl') OR list_contains(t_content, 'gpl'))
SELECT id, score, 2 AS tier, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored
WHERE matched = 3 AND id NOT IN (SELECT id FROM strict) AND (SELECT count(*) FROM strict) < 10 ORDER BY score DESC, id LIMIT 20""",
    "phrase_exclude_filter": r"""SELECT doc_id AS id, lang AS kind FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])apache license($|[^\p{L}\p{N}_])')
AND regexp_matches(text, '(^|[^\p{L}\p{N}_])Version 2($|[^\p{L}\p{N}_])') AND NOT regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])warranty($|[^\p{L}\p{N}_])')""",
    "browse_filter_only": f"SELECT doc_id AS id, {sq.NAME} AS name FROM documents WHERE lower(lang) = 'de' AND source IN ('src1', 'src2') ORDER BY doc_id LIMIT 100",
    "id_prefix_jump": "SELECT page_id, url, md5(url) AS key FROM pages WHERE starts_with(md5(url), 'a') ORDER BY page_id LIMIT 1",
    "document_frequency": f"WITH {_VOCAB} SELECT term, df FROM vocab",
    "title_keyword_counts": f"WITH {sq.FLAT} SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t_name)) AS token FROM flat) GROUP BY token",
    "title_cooccurrence": f"""WITH {sq.FLAT} SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(t_name)) AS token FROM flat WHERE list_contains(t_name, 'ertion'))
WHERE starts_with(token, 'th') AND token <> 'ertion' GROUP BY token ORDER BY n DESC, token LIMIT 8""",
    "inherited_keywords": f"""WITH nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
terms AS (SELECT id, unnest(list_distinct({sq.index_terms("name")})) AS term FROM nodes), df AS (SELECT term FROM terms GROUP BY term HAVING count(*) <= 50),
up AS (SELECT id, parent AS a FROM nodes WHERE parent IS NOT NULL UNION ALL SELECT n.id, p.parent FROM nodes n JOIN nodes p ON n.parent = p.id WHERE p.parent IS NOT NULL)
SELECT DISTINCT up.id, t.term FROM up JOIN terms t ON up.a = t.id JOIN df USING (term) WHERE NOT EXISTS (SELECT 1 FROM terms o WHERE o.id = up.id AND o.term = t.term)""",
    "abbreviation_harvest": r"""WITH w AS (SELECT list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])) AS words FROM part)
SELECT array_to_string(list_transform(words, lambda x: x[1]), '') AS acronym, array_to_string(words, ' ') AS phrase, count(*) AS n FROM w WHERE len(words) BETWEEN 2 AND 6 GROUP BY 1, 2""",
    "collision_dropped_aliases": "SELECT alias, min(owner) AS owner FROM (SELECT string_split(p_name, ' ')[1] AS alias, p_brand AS owner FROM part UNION ALL SELECT lower(s_name), s_name FROM supplier) GROUP BY alias HAVING count(DISTINCT owner) = 1",
    "match_evidence": f"""WITH {sq.FLAT} SELECT id, CAST(min(g) AS INTEGER) AS evidence FROM (SELECT id, CASE WHEN w = 'licensed' THEN 0 WHEN starts_with(w, '{tx.porter_stem("licensed")}') AND length(w) <= {len(tx.porter_stem("licensed")) + 3} THEN 1
  WHEN starts_with(w, 'licensed') THEN 2 WHEN abs(length(w) - 8) <= 2 AND levenshtein(w, 'licensed') <= 2 THEN 3 END AS g
  FROM (SELECT id, unnest(list_distinct(t_content)) AS w FROM flat)) WHERE g IS NOT NULL GROUP BY id""",
    "term_coverage": f"""WITH {sq.FLAT} SELECT id, CAST(n AS INTEGER) AS covered, round(n / 4.0::DOUBLE, 6) AS coverage FROM
(SELECT id, len(list_intersect(['apache', 'license', 'version', 'public'], t_content)) AS n FROM flat) WHERE n > 0""",
    "exact_window": f"""WITH t AS (SELECT doc_id AS id, {_RAW} AS tokens FROM documents),
p AS (SELECT id, i, tokens[i] AS w FROM t, LATERAL (SELECT unnest(range(1, len(tokens) + 1)) AS i) WHERE tokens[i] IN ('license', 'version'))
SELECT DISTINCT a.id FROM p a JOIN p b ON a.id = b.id AND a.w = 'license' AND b.w = 'version' AND abs(a.i - b.i) <= 3""",
    "section_page_caps": f"""WITH {sq.scored(LOOSE)}, s AS (SELECT id, score, CASE matched WHEN 3 THEN 'exact' WHEN 2 THEN 'similar' ELSE 'partial' END AS section FROM scored)
SELECT id, section, CAST(place AS INTEGER) AS place, section_total, score FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, id) AS place, count(*) OVER (PARTITION BY section) AS section_total FROM s) WHERE place <= 5""",
    "diversity_interleave": f"""WITH {sq.scored(["license"])}, ranked AS ({_LICENSE} LIMIT 40),
w AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY rank) AS wave, min(rank) OVER (PARTITION BY scope) AS f FROM ranked)
SELECT id, scope, rank, CAST(wave AS INTEGER) AS wave, CAST(row_number() OVER (ORDER BY wave, f) AS INTEGER) AS position FROM w""",
    "title_priority": f"""WITH {sq.scored(["license"])}, ranked AS ({_LICENSE} LIMIT 40), named AS (SELECT r.*, f.name FROM ranked r JOIN flat f USING (id)),
q AS (SELECT lower(name) AS q FROM named ORDER BY rank DESC LIMIT 1)
SELECT id, rank, CAST(row_number() OVER (ORDER BY CAST({sq.fold("trim(name)")} = array_to_string(list_filter(string_split(q, ' '), lambda w: w <> ''), ' ') AS INT) DESC, rank) AS INTEGER) AS position FROM named, q""",
    "strict_count_probe": f"WITH {sq.scored(TERMS)} SELECT count(*) AS n FROM scored WHERE matched = {len(TERMS)}",
    "weak_split": f"""WITH {sq.scored(["license"])}, ranked AS ({_LICENSE} LIMIT 100) SELECT id, rank, round(score / max(score) OVER (), 6) < 0.6 AS weak FROM ranked""",
    "fold_accents": f"SELECT doc_id, {sq.fold(sq.NAME)} AS folded FROM documents",
    "tokens": f"SELECT doc_id, CAST(len({_RAW}) AS INTEGER) AS n, md5(array_to_string({_RAW}, ' ')) AS digest FROM documents",
    "compound_pieces": f"SELECT doc_id, token, array_to_string({sq.pieces('[token]')}, '|') AS pieces FROM (SELECT doc_id, unnest({_RAW}) AS token FROM documents) WHERE contains(token, '-')",
    "shingles": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i, w FROM w WHERE len(w) > 0),
u AS (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s, min(i) AS i FROM g GROUP BY 1, 2)
SELECT doc_id, CAST(count(s) AS INTEGER) AS n, md5(coalesce(string_agg(s, '|' ORDER BY i), '')) AS digest FROM w LEFT JOIN u USING (doc_id) GROUP BY doc_id""",
    "identifier_tokens": f"SELECT * FROM (SELECT doc_id, unnest({_RAW}) AS token FROM documents) WHERE regexp_full_match(token, '0x[0-9a-f]+') OR (regexp_full_match(token, '[0-9a-f]{{8,}}') AND regexp_matches(token, '[a-f]') AND regexp_matches(token, '[0-9]'))",
    "first_sentences": r"SELECT doc_id, left(CASE WHEN regexp_matches(trim(text), '(?s)^.*?[.!?](\s|$)') THEN regexp_extract(trim(text), '(?s)^(.*?[.!?])(?:\s|$)', 1) ELSE trim(text) END, 220) AS sentence FROM documents",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "stop_word_share": f"SELECT doc_id, CAST(len(list_filter({_RAW}, lambda w: list_contains({sq._STOP}, w))) AS INTEGER) AS stops, CAST(len({_RAW}) AS INTEGER) AS tokens FROM documents",
    "postings_index": f"""WITH {sq.FLAT}, p AS (SELECT 'name' AS field, id, unnest(t_name) AS t FROM flat UNION ALL SELECT 'content', id, unnest(t_content) FROM flat),
g AS (SELECT field, id, t, count(*) AS tf FROM p GROUP BY ALL) SELECT field, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM g GROUP BY field""",
}
