"""Trees as (id, parent) rows: closure, paths, order keys and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.staging import written


def closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance), each node its own ancestor at 0.

    Ancestors double in distance with each round, so that rounds grow with the logarithm of the depth; each
    round's rows are written, so that later ones do not make them anew.  A cycle raises ValueError.
    """
    edges = nodes.select("id", F.col("parent").alias("ancestor")).filter(F.col("ancestor").isNotNull())
    edges = edges.join(nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", F.lit(1).alias("distance"))
    known = more = written(edges)
    reach = 1
    while True:
        rows, loops = more.agg(F.count(F.lit(1)), F.count_if(F.col("id") == F.col("ancestor"))).head()
        if loops:
            raise ValueError(f"{loops} nodes are their own ancestors")
        if not rows:
            break
        far = known.filter(F.col("distance") == reach).select(F.col("id"), F.col("ancestor").alias("mid"))
        more = far.join(known.select(F.col("id").alias("mid"), "ancestor", "distance"), "mid").select("id", "ancestor", (F.col("distance") + reach).alias("distance"))
        more = written(more)
        known, reach = known.unionByName(more), 2 * reach
    own = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    return own.unionByName(known)


def paths(nodes: DataFrame) -> DataFrame:
    """(id, path): the ids from the root to the node."""
    steps = F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ancestor").alias("a")))
    return closure(nodes).groupBy("id").agg(F.transform(F.sort_array(steps), lambda s: s["a"]).alias("path"))


def flattened(nodes: DataFrame) -> DataFrame:
    """(id, parent, depth, position) in depth-first order; siblings by ``ord``, then id."""
    key = nodes.select(F.col("id").alias("ancestor"), F.struct("ord", F.col("id").alias("i")).alias("k"))
    steps = F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("k").alias("k")))
    keyed = closure(nodes).join(key, "ancestor").groupBy("id").agg(F.transform(F.sort_array(steps), lambda s: s["k"]).alias("key"))
    out = nodes.join(keyed, "id")
    return out.withColumn("position", F.row_number().over(Window.orderBy("key")) - 1).select("id", "parent", (F.size("key") - 1).alias("depth"), "position")


def subtree(nodes: DataFrame, root: Column) -> DataFrame:
    """Ids at or under the nodes that ``root`` selects."""
    return closure(nodes).join(nodes.filter(root).select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()


def children_count(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("children"))


def prefixes(number: Column, separator: str = ".") -> Column:
    """The proper prefixes of a dotted number, shortest first."""
    parts = F.split(number, rf"\{separator}")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    return F.filter(every, lambda p: p != number)


def nearest_existing(numbers: DataFrame) -> DataFrame:
    """(number, parent): the longest proper prefix that is itself a row; null for roots."""
    up = numbers.select("number", F.explode(prefixes(F.col("number"))).alias("parent"))
    real = up.join(numbers.select(F.col("number").alias("parent")).distinct(), "parent", "left_semi")
    best = real.groupBy("number").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return numbers.select("number").distinct().join(best, "number", "left")


def natural_key(number: Column) -> Column:
    """Sorts "A.2" before "A.10": digits as numbers, before other text; the empty number is last."""
    chunks = F.regexp_extract_all(F.regexp_replace(number, "^[A-Za-z]+\\.?", ""), F.lit(r"(\d+|[^\d.]+)"), F.lit(1))
    keys = F.transform(chunks, lambda c: F.struct(F.when(c.rlike(r"^\d+$"), 0).otherwise(1).alias("t"), F.when(c.rlike(r"^\d+$"), c.cast("long")).otherwise(0).alias("n"), c.alias("c")))
    return F.struct(F.when(F.coalesce(number, F.lit("")) == "", 1).otherwise(0).alias("empty"), keys.alias("keys"))


def canonical_order(numbers: DataFrame) -> DataFrame:
    """(number, position): at each level real documents, then numbers of absent ones, then segments that are no integers."""
    parts = F.split("number", r"\.")
    steps = numbers.select("number", F.posexplode(parts).alias("level", "segment"))
    steps = steps.withColumn("prefix", F.array_join(F.slice(F.split("number", r"\."), F.lit(1), F.col("level") + 1), "."))
    real = numbers.select(F.col("number").alias("prefix"), F.lit(True).alias("real")).distinct()
    steps = steps.join(real, "prefix", "left")
    whole = F.col("segment").rlike(r"^\d+$")
    kind = F.when(~whole & (F.col("level") > 0), 2).when(F.col("real"), 0).otherwise(1)
    entry = F.struct("level", kind.alias("kind"), F.when(whole, F.col("segment").cast("long")).otherwise(0).alias("n"), "segment")
    keyed = steps.groupBy("number").agg(F.sort_array(F.collect_list(entry)).alias("key"))
    key = F.transform("key", lambda e: F.struct(e["kind"].alias("kind"), e["n"].alias("n"), e["segment"].alias("s")))
    return keyed.select("number", F.row_number().over(Window.orderBy(key)).alias("position"))


def scope_chips(results: DataFrame, most: int = 6) -> DataFrame:
    """Ancestors of results (id, path) that split them most evenly: (node, covered)."""
    total = results.agg(F.count(F.lit(1)).alias("total"))
    seen = results.select(F.explode(F.array_distinct("path")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("covered"))
    split = seen.crossJoin(F.broadcast(total)).filter("covered < total").withColumn("off", F.abs(F.col("total") / 2 - F.col("covered")))
    return split.orderBy("off", "node").limit(most).select("node", "covered")


def distinguishing(results: DataFrame, most: int = 2) -> DataFrame:
    """(id, label): of each row's path the rarest segments among all results, deeper first on ties, in path order."""
    steps = results.select("id", F.posexplode("path").alias("level", "segment"))
    steps = steps.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("level", "segment")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", F.desc("level")))
    kept = steps.withColumn("place", place).filter(F.col("place") <= most)
    return kept.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "segment"))), lambda s: s["segment"]), " > ").alias("label"))


def mini_tree(nodes: DataFrame, focus, window: int = 5) -> DataFrame:
    """The focus among its siblings: a window of them with how many are hidden before and after."""
    at = nodes.filter(F.col("id") == focus).select(F.col("parent").alias("_p"))
    siblings = nodes.join(F.broadcast(at), F.col("parent").eqNullSafe(F.col("_p"))).drop("_p")
    by = Window.partitionBy(F.lit(0))
    ranked = siblings.withColumn("i", F.row_number().over(Window.orderBy("id")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    ranked = ranked.withColumn("f", F.max(F.when(F.col("id") == focus, F.col("i"))).over(by))
    first = F.greatest(F.lit(0), F.least(F.col("f") - window // 2, F.col("n") - window))
    ranked = ranked.withColumn("hidden_before", first).withColumn("hidden_after", F.greatest(F.lit(0), F.col("n") - first - window))
    return ranked.filter((F.col("i") >= first) & (F.col("i") < first + window)).select("id", "i", "hidden_before", "hidden_after")
