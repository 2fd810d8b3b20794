"""Keyword retrieval: fields, BM25-style scores, tiers, filters and match evidence.

Documents are (id, name, content, kind, scope, depth).  A search first reduces each document to the few
numbers the query needs (field lengths and term counts), inside the scan; only those rows are aggregated
for the corpus statistics and ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.staging import written

# Field boosts, and the constants of the BM25+ formula.
FIELD_BOOSTS = {"doc_no": 5.0, "name": 3.0, "content": 1.0, "extras": 1.0, "expansion": 0.25}
K, B, DELTA = 1.2, 0.7, 0.5
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY_SHARE = 0.375, 0.45, 0.2
RESULT_LIMIT, STRICT_GATE, EXPANSION_CAP = 100, 10, 20


def flat_documents(documents: DataFrame) -> DataFrame:
    """The driver's documents in the flat form: the first line is the name, lang the kind, source the scope."""
    return documents.select(
        F.col("doc_id").alias("id"), tx.first_line(F.col("text")).alias("name"), F.coalesce("text", F.lit("")).alias("content"),
        F.col("lang").alias("kind"), F.col("source").alias("scope"), F.pmod("doc_id", F.lit(6)).cast("int").alias("depth"),
    )


def depth_boost(depth: Column) -> Column:
    return 1 + F.greatest(F.lit(0), 4 - depth) * 0.05


def _equals(word: str):
    return lambda t: t == word


def term_counts(docs: DataFrame, terms: Sequence[str], fields: Sequence[str] = ("name", "content")) -> DataFrame:
    """(id, kind, scope, depth, len_<field>, tf_<field>: counts in the order of ``terms``)."""
    def counted(tokens: Column) -> Column:
        return F.struct(F.size(F.array_distinct(tokens)).alias("len"), F.array(*[F.size(F.filter(tokens, _equals(w))) for w in terms]).alias("tf"))

    each = F.struct(*[tx.let(tx.index_terms(F.col(f)), counted).alias(f) for f in fields])
    # Generated, so that no filter or projection above is moved below it and makes the tokens again.
    rows = docs.select("id", "kind", "scope", "depth", F.explode(F.array(each)).alias("c"))
    flat = [F.col(f"c.{f}.{x}").alias(f"{x}_{f}") for f in fields for x in ("len", "tf")]
    return rows.select("id", "kind", "scope", "depth", *flat)


def scored(docs: DataFrame, terms: Sequence[str], fields: Sequence[str] = ("name", "content"), where: Column | None = None) -> DataFrame:
    """(id, kind, scope, depth, score, matched) of documents that match a term.

    ``score`` sums, over terms and fields, boost * ln(1 + (N - n + .5) / (n + .5)) * (delta + tf(k+1) / (tf + k(1 - b + b len/avg))), times
    the number of matched terms and the depth boost.  ``where`` filters documents before ranking; the statistics
    are the whole corpus's.
    """
    # The statistics and the ranking both need the counts: a few numbers a document, so that texts are read once.
    counts = written(term_counts(docs, terms, fields))
    stats = [F.count(F.lit(1)).alias("n")]
    for f in fields:
        stats.append(F.avg(f"len_{f}").alias(f"avg_{f}"))
        stats += [F.sum((F.col(f"tf_{f}")[i] > 0).cast("long")).alias(f"df_{f}_{i}") for i in range(len(terms))]
    corpus = counts.agg(*stats)  # one row
    hit = reduce(lambda a, b: a | b, [F.col(f"tf_{f}")[i] > 0 for f in fields for i in range(len(terms))])
    rows = counts.filter(hit if where is None else hit & where).crossJoin(F.broadcast(corpus))
    parts = []
    for f in fields:
        for i in range(len(terms)):
            tf, df = F.col(f"tf_{f}")[i], F.col(f"df_{f}_{i}")
            idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
            saturated = DELTA + tf * (K + 1) / (tf + K * (1 - B + B * F.col(f"len_{f}") / F.col(f"avg_{f}")))
            parts.append(F.when(tf > 0, FIELD_BOOSTS[f] * idf * saturated).otherwise(F.lit(0.0)))
    matched = reduce(lambda a, b: a + b, [reduce(lambda a, b: a | b, [F.col(f"tf_{f}")[i] > 0 for f in fields]).cast("int") for i in range(len(terms))])
    score = reduce(lambda a, b: a + b, parts) * matched * depth_boost(F.col("depth"))
    return rows.select("id", "kind", "scope", "depth", F.round(score, 6).alias("score"), matched.alias("matched"))


def top(rows: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The first ``limit`` by score, then id, with their rank."""
    best = rows.orderBy(F.desc(score), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def search_all(docs: DataFrame, terms: Sequence[str], limit: int = RESULT_LIMIT, where: Column | None = None, fields=("name", "content")) -> DataFrame:
    """The strict pass: documents with all terms."""
    rows = scored(docs, terms, fields, where)
    return top(rows.filter(F.col("matched") == len(terms)), limit)


def tiers(docs: DataFrame, terms: Sequence[str], limit: int = RESULT_LIMIT) -> DataFrame:
    """Strict matches and, only if they are fewer than ``limit``, the rest that match any term, below them.

    One plan: the gate is a count of the strict rows that is compared, not an action.
    """
    rows = scored(docs, terms).withColumn("tier", F.when(F.col("matched") == len(terms), 0).otherwise(1))
    # Each tier is cut before the gate is looked at, so that the windows below see 2 x limit rows.
    strict = rows.filter("tier = 0").orderBy(F.desc("score"), "id").limit(limit)
    relaxed = rows.filter("tier = 1").orderBy(F.desc("score"), "id").limit(limit)
    both = strict.unionByName(relaxed)
    gate = F.sum((F.col("tier") == 0).cast("int")).over(Window.partitionBy(F.lit(0)))
    open_ = both.withColumn("strict_count", gate).filter((F.col("tier") == 0) | (F.col("strict_count") < limit))
    place = F.row_number().over(Window.orderBy("tier", F.desc("score"), "id"))
    return open_.withColumn("rank", place).filter(F.col("rank") <= limit).drop("strict_count")


def vocabulary(docs: DataFrame, fields: Sequence[str] = ("name", "content")) -> DataFrame:
    """(term, df): every indexed term and the documents that hold it."""
    terms = F.array_distinct(F.flatten(F.array(*[tx.index_terms(F.col(f)) for f in fields])))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def expand_prefix(words: DataFrame, prefix: str) -> DataFrame:
    """Vocabulary terms that start with ``prefix`` (two letters at least) and their weight."""
    if len(prefix) < 2:
        return words.filter(F.col("term") == prefix).withColumn("weight", F.lit(1.0))
    longer = F.length("term") - len(prefix)
    weight = F.when(longer == 0, F.lit(1.0)).otherwise(PREFIX_WEIGHT * F.length("term") / (F.length("term") + 0.3 * longer))
    return words.filter(F.col("term").startswith(prefix)).withColumn("weight", weight)


def expand_fuzzy(words: DataFrame, term: str) -> DataFrame:
    """Vocabulary terms within a fifth of the term's length, for terms that are unknown, have no dot and four letters."""
    budget = round(FUZZY_SHARE * len(term))
    distance = F.levenshtein(F.col("term"), F.lit(term), budget)
    near = words.withColumn("distance", distance).filter((F.col("distance") >= 0) & (F.col("distance") <= budget))
    if len(term) < 4 or "." in term:
        return near.filter("distance = 0").withColumn("weight", F.lit(1.0))
    known = near.agg(F.coalesce(F.max((F.col("distance") == 0).cast("int")), F.lit(0)).alias("known"))
    weight = F.when(F.col("distance") == 0, F.lit(1.0)).otherwise(FUZZY_WEIGHT * F.length("term") / (F.length("term") + F.col("distance")))
    allowed = near.crossJoin(F.broadcast(known)).filter((F.col("known") == 0) | (F.col("distance") == 0))
    return allowed.drop("known").withColumn("weight", weight)


def postings(docs: DataFrame, fields: Sequence[str] = ("name", "content")) -> DataFrame:
    """The inverted index: (term, field, id, tf)."""
    each = [docs.select("id", F.lit(f).alias("field"), F.explode(tx.index_terms(F.col(f))).alias("term")) for f in fields]
    return reduce(DataFrame.unionByName, each).groupBy("term", "field", "id").agg(F.count(F.lit(1)).alias("tf"))


def field_lengths(docs: DataFrame, fields: Sequence[str] = ("name", "content")) -> DataFrame:
    each = [docs.select("id", "depth", F.lit(f).alias("field"), F.size(F.array_distinct(tx.index_terms(F.col(f)))).alias("n")) for f in fields]
    return reduce(DataFrame.unionByName, each)


def write_index(docs: DataFrame, path: str, corpus_hash: str, buckets: int = 64) -> None:
    """Index tables under ``path``: postings clustered by term, lengths, statistics and the corpus hash they hold for."""
    rows = postings(docs).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "term", "field", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths = field_lengths(docs)
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    stats = lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("avg_n")).withColumn("corpus_hash", F.lit(corpus_hash)).withColumn("buckets", F.lit(buckets))
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark, path: str, terms: Sequence[str], limit: int = RESULT_LIMIT, corpus_hash: str | None = None, every: bool = True) -> DataFrame | None:
    """Ranks by the written index: reads only the terms' buckets.  None if the index is of another corpus."""
    stats = spark.read.parquet(f"{path}/stats")
    first = stats.select("corpus_hash", "buckets").head()
    if first is None or (corpus_hash is not None and first.corpus_hash != corpus_hash):
        return None
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(first.buckets)).cast("int").alias("b"))
    numbers = sorted({r.b for r in wanted.collect()})
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(numbers) & F.col("term").isin(list(terms)))
    df = hits.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), ["term", "field"]).join(spark.read.parquet(f"{path}/lengths").withColumnRenamed("n", "len"), ["id", "field"])
    rows = rows.join(F.broadcast(stats.select("field", "n", "avg_n")), "field")
    boost = F.create_map(*[x for k, v in FIELD_BOOSTS.items() for x in (F.lit(k), F.lit(v))])[F.col("field")]
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = boost * idf * (DELTA + F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("len") / F.col("avg_n"))))
    found = rows.groupBy("id").agg(F.sum(part).alias("s"), F.count_distinct("term").alias("matched"), F.first("depth").alias("depth"))
    found = found.filter(F.col("matched") == len(terms)) if every else found
    return top(found.select("id", F.round(F.col("s") * F.col("matched") * depth_boost(F.col("depth")), 6).alias("score"), "matched"), limit)


def promoted(ranked: DataFrame, target: int, place: int) -> DataFrame:
    """Moves one document up to ``place`` if it ranks below it; the others keep their order."""
    current = F.max(F.when(F.col("id") == target, F.col("rank"))).over(Window.partitionBy(F.lit(0)))
    key = F.when(F.col("id") == target, F.least(F.col("rank"), F.lit(place)) - 0.5).otherwise(F.col("rank").cast("double"))
    return ranked.withColumn("_now", current).withColumn("rank", F.row_number().over(Window.orderBy(key))).drop("_now")


def expanded_tier(docs: DataFrame, terms: Sequence[str], phrases: dict[str, Sequence[str]], limit: int = RESULT_LIMIT) -> DataFrame:
    """Strict matches, and below them those of the query with its first abbreviation spelled out, if the former are few."""
    strict = search_all(docs, terms, limit).select("id", "score", F.lit(0).alias("tier"))
    known = next((t for t in terms if t in phrases), None)
    if known is None:
        return strict.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    longer = [t for t in terms if t != known] + [w for w in phrases[known] if w not in terms]
    more = search_all(docs, longer, limit).select("id", "score", F.lit(2).alias("tier"))
    more = more.join(F.broadcast(strict.select("id")), "id", "left_anti").orderBy(F.desc("score"), "id").limit(EXPANSION_CAP)
    few = F.sum((F.col("tier") == 0).cast("int")).over(Window.partitionBy(F.lit(0)))
    both = strict.unionByName(more).withColumn("_n", few).filter((F.col("tier") == 0) | (F.col("_n") < STRICT_GATE)).drop("_n")
    return both.withColumn("rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), "id")))


def phrase_filter(content: Column, phrases: Sequence[str] = (), exact: Sequence[str] = (), excluded: Sequence[str] = ()) -> Column:
    """All phrases (either case) and exact phrases, none of the excluded words, each between non-letters."""
    tests = [content.rlike(tx.word_boundary(p)) for p in phrases] + [content.rlike(tx.word_boundary(p, case=True)) for p in exact]
    tests += [~content.rlike(tx.word_boundary(w)) for w in excluded]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def match_evidence(docs: DataFrame, term: str) -> DataFrame:
    """(id, evidence): how a document's best word answers the term: exact, word form, prefix or typo (0 to 3)."""
    tokens = F.array_distinct(tx.index_terms(F.col("content")))
    budget = round(FUZZY_SHARE * len(term))
    stem = tx.porter_stem(term)
    grade = F.array_min(
        F.transform(tokens, lambda t: F.when(t == term, 0).when(t.startswith(stem) & (F.length(t) <= len(stem) + 3), 1).when(t.startswith(term), 2)
                    .when(F.levenshtein(t, F.lit(term), budget) >= 0, 3))
    )
    return docs.select("id", grade.alias("evidence")).filter("evidence IS NOT NULL")


def coverage(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, covered, coverage): the distinct query terms a document holds, of those asked for."""
    wanted = F.array(*[F.lit(t) for t in terms])
    n = F.size(F.array_intersect(wanted, tx.index_terms(F.col("content"))))
    return docs.select("id", n.alias("covered"), F.round(n / F.lit(len(set(terms))), 6).alias("coverage")).filter("covered > 0")


def exact_window(docs: DataFrame, terms: Sequence[str], gap: int = 2) -> DataFrame:
    """Ids of documents with all terms inside m + (m - 1) * gap consecutive words of a field, in any order."""
    m = len(set(terms))
    width = m + (m - 1) * gap
    tokens = tx.raw_tokens(F.col("content"))
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(list(terms)), i)), lambda p: p.isNotNull())
    rows = docs.select("id", tokens.alias("tokens"), places.alias("places"))
    inside = lambda p: F.size(F.array_intersect(F.slice(F.col("tokens"), p + 1, width), F.array(*[F.lit(t) for t in terms]))) == m
    return rows.filter(F.exists("places", inside)).select("id")


def paged_sections(rows: DataFrame, section: Column, size: int = 5) -> DataFrame:
    """The first ``size`` of each section by score, with the section's whole count."""
    by = Window.partitionBy("section")
    out = rows.withColumn("section", section).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "id")))
    return out.withColumn("section_total", F.count(F.lit(1)).over(by)).filter(F.col("place") <= size)


def interleaved(ranked: DataFrame, key: str) -> DataFrame:
    """Round robin over ``key``: the first of each key, in rank order, then the second of each."""
    by = Window.partitionBy(key)
    waves = ranked.withColumn("wave", F.row_number().over(by.orderBy("rank"))).withColumn("_first", F.min("rank").over(by))
    return waves.withColumn("position", F.row_number().over(Window.orderBy("wave", "_first"))).drop("_first")


def title_first(ranked: DataFrame, query: str) -> DataFrame:
    """Rows whose folded name is the folded query come first; all else keeps its order."""
    same = (tx.fold(F.btrim("name")) == " ".join(query.lower().split())).cast("int")
    return ranked.withColumn("position", F.row_number().over(Window.orderBy(F.desc(same), "rank")))


def title_keywords(docs: DataFrame) -> DataFrame:
    """(token, df): the distinct terms of names and how many names hold them."""
    return docs.select(F.explode(F.array_distinct(tx.index_terms(F.col("name")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def suggest_titles(docs: DataFrame, context: Sequence[str], prefix: str, limit: int = 8) -> DataFrame:
    """Title terms that start with ``prefix`` and stand in names that hold every context term."""
    terms = F.array_distinct(tx.index_terms(F.col("name")))
    wanted = F.array(*[F.lit(c) for c in context]).cast("array<string>")
    names = docs.select(terms.alias("terms")).filter(F.size(F.array_except(wanted, F.col("terms"))) == 0)
    found = names.select(F.explode("terms").alias("token")).filter(F.col("token").startswith(prefix) & ~F.col("token").isin(list(context)))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(limit)


def inherited_terms(nodes: DataFrame, closure: DataFrame, most_df: int) -> DataFrame:
    """(id, term): rare terms of a node's ancestors' names that its own name lacks."""
    terms = nodes.select("id", F.explode(F.array_distinct(tx.index_terms(F.col("name")))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= most_df)
    above = closure.filter("distance > 0").select("id", F.col("ancestor").alias("_a"))
    passed = above.join(terms.withColumnRenamed("id", "_a"), "_a").join(df.select("term"), "term").select("id", "term").distinct()
    return passed.join(terms, ["id", "term"], "left_anti")


def harvested_abbreviations(docs: DataFrame) -> DataFrame:
    """(acronym, phrase, n) of "Capital Words (CW)" passages whose words' initials are the acronym."""
    found = F.regexp_extract_all(F.col("content"), F.lit(r"((?:[A-Z][a-z]+ ){2,6}\([A-Z]{2,6}\))"), F.lit(1))
    rows = docs.select(F.explode(found).alias("m"))
    rows = rows.select(F.regexp_extract("m", r"\(([A-Z]+)\)", 1).alias("acronym"), F.btrim(F.regexp_replace("m", r"\([A-Z]+\)", "")).alias("words"))
    taken = F.slice(F.split("words", " "), -F.least(F.length("acronym"), F.size(F.split("words", " "))), F.length("acronym"))
    rows = rows.withColumn("phrase", F.array_join(taken, " ")).withColumn("initials", F.array_join(F.transform(taken, lambda w: F.substring(w, 1, 1)), ""))
    return rows.filter("initials = acronym").groupBy("acronym", "phrase").agg(F.count(F.lit(1)).alias("n"))


def unambiguous(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner) of keys that one owner alone claims; a key with two owners is dropped."""
    return rows.groupBy(key).agg(F.min(owner).alias(owner), F.count_distinct(owner).alias("_n")).filter("_n = 1").drop("_n")
