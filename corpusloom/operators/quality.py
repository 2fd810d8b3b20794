"""Rule checks that give a row an issue, and the deterministic parts of question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_QUOTE = 15


def duplicate_ids(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, first, n) of keys that more than one row has."""
    return rows.groupBy(key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def bad_ids(rows: DataFrame, key: str, pattern: str) -> DataFrame:
    """Rows whose key is missing, empty or of another form, with the kind of issue."""
    kind = F.when(F.col(key).isNull(), "missing").when(F.col(key) == "", "empty").when(~F.col(key).rlike(pattern), "format")
    return rows.withColumn("issue", kind).filter("issue IS NOT NULL")


def bad_nesting(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Children whose (parent_kind, kind) is not among the allowed pairs; the rules are a short table."""
    return rows.join(F.broadcast(allowed), ["parent_kind", "kind"], "left_anti")


def order_gaps(rows: DataFrame, parent: str, number: str) -> DataFrame:
    """Rows whose number does not follow its predecessor's within the parent."""
    before = F.lag(number).over(Window.partitionBy(parent).orderBy(number))
    return rows.withColumn("before", before).filter(F.col(number) - F.coalesce("before", F.col(number) - 1) != 1)


def completeness(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """(kind, expected, found) of kinds whose counts differ, missing ones counting 0."""
    a = left.groupBy(kind).agg(F.count(F.lit(1)).alias("expected"))
    b = right.groupBy(kind).agg(F.count(F.lit(1)).alias("found"))
    out = a.join(b, kind, "full_outer").select(kind, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return out.filter("expected <> found")


def blank_line_issues(lines: DataFrame) -> DataFrame:
    """Headings without a blank line after them: (doc, line)."""
    after = F.lead("text").over(Window.partitionBy("doc").orderBy("line"))
    return lines.withColumn("after", after).filter(F.col("text").rlike("^#{1,6} ") & (F.trim(F.coalesce("after", F.lit(""))) != "")).select("doc", "line")


def quote_form(text: Column) -> Column:
    """Curly quotes straight, white space single, lower case."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "‘’“”", "''\"\"")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def verified(claims: DataFrame, docs: DataFrame) -> DataFrame:
    """(claim, doc, faithful): the quote is long enough and stands in the cited document word for word."""
    joined = claims.join(docs.select("doc", "text"), "doc", "left")
    quote = quote_form(F.col("quote"))
    return joined.select("claim", "doc", ((F.length(quote) >= LEAST_QUOTE) & F.coalesce(F.contains(quote_form(F.col("text")), quote), F.lit(False))).alias("faithful"))


def number_leaks(rows: DataFrame, made: str, source: str) -> DataFrame:
    """Rows with the numbers of the made text that its source lacks."""
    numbers = F.array_distinct(F.regexp_extract_all(F.col(made), F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))
    return rows.withColumn("leaks", F.filter(numbers, lambda n: ~F.contains(F.col(source), n))).filter(F.size("leaks") > 0)


def count_answer(nodes: DataFrame, words: list[str]) -> DataFrame:
    """The best-named parent's number of children: all words in its name, then the shortest name, then the most children."""
    held = F.size(F.array_except(F.array(*[F.lit(w) for w in words]), F.split(F.lower("name"), "[^a-z0-9]+"))) == 0
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    found = nodes.filter(held).select("id", "name").join(children, "id")
    return found.orderBy(F.length("name"), F.desc("children"), "id").limit(1).select("id", "name", "children")
