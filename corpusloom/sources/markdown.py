"""Readers and writers of document corpora kept as markdown.

Two layouts give the same rows: ``atoms`` (a folder a document, each with a document.md that starts with
front matter) and ``buckets`` ("<number> - <name>.md" files of several documents under headings).  Both
readers work a file a row and never list files on the driver; only the layout test looks at the top folder.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import tree
from corpusloom.staging import written

# Keys an atom must have, and the form of a title line.
REQUIRED = ("id", "docNo", "name", "type", "depth", "childType")
TITLE = r"^(#{1,6}) (\S+) - (.+) \[([^\]]+)\]\s+<!-- UUID: ([0-9a-fA-F-]{36}) -->\s*$"
BUCKET_FILE = r"^(.+?) - .+\.md$"
RESEARCH = "Needed Research"


class LayoutError(ValueError):
    """Neither layout, or both."""


def detect_layout(spark: SparkSession, root: str) -> str:
    """``atoms`` or ``buckets``, by the entries of the top folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    folders = [e.getPath().getName() for e in entries if e.isDirectory()]
    files = [e.getPath().getName() for e in entries if not e.isDirectory()]
    atoms, buckets = any(f in ("A", "NR") for f in folders), any(re.match(BUCKET_FILE, f) for f in files)
    if atoms == buckets:
        raise LayoutError(f"{root}: {'both layouts' if atoms else 'no known layout'}")
    return "atoms" if atoms else "buckets"


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of the files under ``root`` whose names match."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def unquoted(name: Column) -> Column:
    """A YAML scalar: double quotes with escapes, single quotes with doubled ones, or plain."""
    double = F.regexp_replace(F.regexp_replace(F.substring(name, F.lit(2), F.length(name) - 2), r'\\"', '"'), r"\\\\", r"\\")
    single = F.regexp_replace(F.substring(name, F.lit(2), F.length(name) - 2), "''", "'")
    return F.when(name.rlike(r'^".*"$'), double).when(name.rlike(r"^'.*'$"), single).otherwise(name)


def inline_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s*\[|\]\s*$", ""), ","), lambda x: F.btrim(x, F.lit(" \"'"))), lambda x: x != "")


def parsed_atoms(files: DataFrame, strict: bool = True) -> DataFrame:
    """Documents of (path, text).  ``strict`` fails on a file without complete front matter; else such files are left out."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    body = F.regexp_extract("text", r"(?s)\A---\n.*?\n---\n*(?:[^\n]*\n?)(.*)\z", 1)
    pairs = F.filter(F.split(front, "\n"), lambda line: F.instr(line, ":") > 0)
    entries = F.transform(pairs, lambda line: F.struct(F.btrim(F.substring_index(line, ":", 1)).alias("k"), F.btrim(F.regexp_replace(line, "^[^:]*:", "")).alias("v")))
    rows = files.select("path", entries.alias("e"), body.alias("body"))
    whole = reduce(lambda a, b: a & b, [F.exists("e", _key_is(k)) for k in REQUIRED])
    if strict:
        rows = rows.withColumn("e", F.when(whole, F.col("e")).otherwise(F.raise_error(F.concat(F.lit("incomplete front matter: "), "path")).cast(rows.schema["e"].dataType)))
    else:
        rows = rows.filter(whole)
    last = lambda k: F.element_at(F.transform(F.filter("e", _key_is(k)), lambda x: x["v"]), -1)
    targets = F.when(F.exists("e", _key_is("targets")), inline_list(F.element_at(F.transform(F.filter("e", _key_is("targets")), lambda x: x["v"]), -1))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.lower(last("id")).alias("uuid"), last("docNo").alias("number"), unquoted(last("name")).alias("name"), last("type").alias("kind"),
        last("depth").try_cast("int").alias("depth"), last("childType").alias("child_kind"), targets.alias("targets"), F.btrim("body", F.lit("\n")).alias("body"), "path",
    )


def _key_is(key: str):
    return lambda x: x["k"] == key


def heading_lines(files: DataFrame) -> DataFrame:
    """(path, line, text, segment): lines with the running number of the title they stand under; code fences hold no titles."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    by = Window.partitionBy("path").orderBy("line")
    fence = F.sum(F.col("text").rlike(r"^\s*```").cast("int")).over(by)
    title = F.col("text").rlike(TITLE) & (F.col("fence") % 2 == 0)
    return lines.withColumn("fence", fence).withColumn("segment", F.sum(title.cast("int")).over(by)).drop("fence")


def parsed_monolith(files: DataFrame) -> DataFrame:
    """Documents of markdown files under title lines: uuid, number, name, kind, level, body, line_start, line_end, path."""
    lines = heading_lines(files).filter("segment > 0")
    title = F.min_by("text", "line")
    # A segment's first line is its title; others that look like one stand in code fences.
    ordered = F.sort_array(F.collect_list(F.struct("line", "text")))
    rest = F.transform(F.slice(ordered, F.lit(2), F.size(ordered)), lambda x: x["text"])
    rows = lines.groupBy("path", "segment").agg(title.alias("t"), rest.alias("rest"), F.min("line").alias("line_start"), F.max("line").alias("line_end"))
    part = lambda i: F.regexp_extract("t", TITLE, i)
    return rows.select(
        F.lower(part(5)).alias("uuid"), part(2).alias("number"), part(3).alias("name"), part(4).alias("kind"), F.length(part(1)).alias("level"),
        F.btrim(F.array_join("rest", "\n"), F.lit("\n")).alias("body"), "line_start", "line_end", "path",
    )


def duplicate_buckets(files: DataFrame) -> DataFrame:
    """Bucket numbers that two files claim."""
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(.+?)(?:%20| )-(?:%20| ).+\.md$", 1)
    return files.groupBy(number.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def load(spark: SparkSession, root: str) -> DataFrame:
    """(uuid, number, name, kind, body, targets) of a corpus in either layout."""
    if detect_layout(spark, root) == "atoms":
        return parsed_atoms(whole_files(spark, root, "document.md")).select("uuid", "number", "name", "kind", "body", "targets")
    rows = parsed_monolith(whole_files(spark, root, "*.md"))
    return rows.select("uuid", "number", "name", "kind", "body", F.array().cast("array<string>").alias("targets"))


def tar_atoms(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Documents of the document.md members of tar archives, read as streams in the executors."""

    def members(batches):
        import io
        import tarfile

        import pandas as pd

        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.rsplit("/", 1)[-1] == "document.md":
                            rows.append((f"{archive}!{m.name}", tar.extractfile(m).read().decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["path", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "path string, text string")
    return parsed_atoms(files, strict)


def with_parents(docs: DataFrame) -> DataFrame:
    """Adds ``parent_uuid``: research documents belong to their first target, others to the nearest number above that exists."""
    plain = docs.filter((F.col("kind") != RESEARCH) | (F.size("targets") == 0))
    up = tree.nearest_existing(plain.select("number"))
    above = up.join(plain.select(F.col("number").alias("parent"), F.col("uuid").alias("parent_uuid")), "parent", "left").select("number", "parent_uuid")
    first = plain.join(above, "number", "left")
    aimed = docs.filter((F.col("kind") == RESEARCH) & (F.size("targets") > 0)).withColumn("parent_uuid", F.lower(F.get("targets", F.lit(0))))
    return first.unionByName(aimed)


def heading_levels(docs: DataFrame) -> DataFrame:
    """(uuid, level): ancestors that exist and one, six at most; documents that aim at another are one deeper than it."""
    return _levels(written(with_parents(docs)))


def _levels(placed: DataFrame) -> DataFrame:
    nodes = placed.select(F.col("uuid").alias("id"), F.col("parent_uuid").alias("parent"))
    return tree.closure(nodes).groupBy(F.col("id").alias("uuid")).agg(F.least(F.count(F.lit(1)), F.lit(6)).cast("int").alias("level"))


def composed(docs: DataFrame) -> DataFrame:
    """(position, text): one row a document of the whole as markdown, in canonical order, those that aim at another after it."""
    placed = written(with_parents(docs))
    order = tree.canonical_order(docs.filter((F.col("kind") != RESEARCH) | (F.size("targets") == 0)).select("number").distinct()).withColumnRenamed("position", "place")
    own = placed.join(order, "number", "left").select("*")
    target = own.filter("place IS NOT NULL").select(F.col("uuid").alias("parent_uuid"), F.col("place").alias("target_place"))
    aimed = (F.col("kind") == RESEARCH) & (F.size("targets") > 0)
    keyed = own.join(target, "parent_uuid", "left").withColumn("at", F.when(aimed, F.col("target_place")).otherwise(F.col("place"))).withColumn("after", aimed.cast("int"))
    rows = keyed.join(_levels(placed), "uuid")
    position = F.row_number().over(Window.orderBy(F.col("at").asc_nulls_last(), "after", "number", "uuid"))
    title = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "number", F.lit(" - "), "name", F.lit(" ["), "kind", F.lit("]  <!-- UUID: "), "uuid", F.lit(" -->"))
    text = F.when(F.col("body") == "", F.concat(title, F.lit("\n"))).otherwise(F.concat(title, F.lit("\n\n"), "body", F.lit("\n")))
    return rows.select(position.alias("position"), "uuid", "number", "kind", "level", text.alias("text"))


def write_monolith(docs: DataFrame, path: str) -> None:
    """The whole as one text file, in order; blank lines part the documents."""
    composed(docs).orderBy("position").select(F.concat("text", F.lit("\n"))).coalesce(1).write.mode("overwrite").text(path)


def write_scopes(docs: DataFrame, path: str) -> None:
    """A folder of text a top-level number: name made safe for file systems."""
    rows = composed(docs).withColumn("scope", F.regexp_replace(F.substring_index("number", ".", 2), r"[^A-Za-z0-9._-]+", "-"))
    rows.repartition("scope").sortWithinPartitions("scope", "position").select("scope", F.concat("text", F.lit("\n"))).write.mode("overwrite").partitionBy("scope").text(path)


def truncated(docs: DataFrame, most: int = 4) -> DataFrame:
    """Documents at most ``most`` levels deep."""
    return docs.join(heading_levels(docs).filter(F.col("level") <= most).select("uuid"), "uuid", "left_semi")


def extra_fields(body: Column, labels: list[str]) -> Column:
    """A map of the ``**Label**:`` fields of a body: each runs to the next known label; missing ones are empty."""
    every = "|".join(re.escape(x) for x in labels)
    value = lambda x: F.btrim(F.regexp_extract(body, rf"(?s)(?:^|\n)\*\*{re.escape(x)}\*\*:[ \t]*(.*?)(?=\n\*\*(?:{every})\*\*:|\z)", 1), F.lit("\n "))
    return F.create_map(*[y for x in labels for y in (F.lit(x), value(x))])


def tidied(text: Column) -> Column:
    """Curly quotes straight, bullets as hyphens."""
    return F.regexp_replace(F.translate(text, "‘’“”", "''\"\""), r"(?m)^(\s*)[•∙◦]\s*", "$1- ")


def title_issues(files: DataFrame, kinds: list[str]) -> DataFrame:
    """(path, line, issue) of heading lines that are no title, have an unknown kind, or skip levels."""
    lines = heading_lines(files)
    heads = lines.filter(F.col("text").rlike(r"^#{1,6} ") & (F.col("text").rlike(r"\[[^\]]+\]|UUID")))
    level = F.length(F.regexp_extract("text", "^(#+)", 1))
    before = F.lag(level).over(Window.partitionBy("path").orderBy("line"))
    kind = F.regexp_extract("text", TITLE, 4)
    issue = F.when(~F.col("text").rlike(TITLE), "format").when(~kind.isin(kinds), "kind").when(level > F.coalesce(before, F.lit(0)) + 1, "level")
    return heads.select("path", "line", issue.alias("issue")).filter("issue IS NOT NULL")


def corpus_hash(docs: DataFrame, columns: list[str]) -> str:
    """A digest of the rows whatever their order: what derived tables are pinned to."""
    each = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    parts = docs.select(each.alias("h")).agg(*[F.bit_xor(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")).alias(f"x{i}") for i in range(8)], F.count(F.lit(1)).alias("n")).head()
    return f"{parts['n']:x}-" + "".join(f"{parts[f'x{i}'] or 0:08x}" for i in range(8))


def pinned(spark: SparkSession, path: str, expected: str) -> DataFrame | None:
    """A derived table if its ``corpus_hash`` is the expected one; None if it is missing or another's."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    if "corpus_hash" not in rows.columns or rows.filter(F.col("corpus_hash") != expected).limit(1).count():
        return None
    return rows
