"""Trees: closures of a forest, filings rolled up, redundant ancestors, complete sets of children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.locators import ancestors
from ..sources.scratch import written


def closure(folders: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(id, ancestor, distance) with each node as its own at distance 0. Each round doubles the reach, so a path of n
    steps takes log n joins, until nothing changes; a path ends at a missing parent or where it meets itself."""
    nodes = folders.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    known = nodes.select(F.col("id").alias("__known"))
    out = written(nodes.join(known, F.col("up") == F.col("__known")).select("id", F.col("up").alias("ancestor"), F.lit(1).alias("distance")).where("id <> ancestor"))
    held = out.count()
    while True:
        more = out.alias("a").join(out.alias("b"), F.col("a.ancestor") == F.col("b.id")).select("a.id", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        out = written(out.unionByName(more).where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        before, held = held, out.count()
        if held == before:
            break
    return out.unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))


def counts(filings: DataFrame, closed: DataFrame, folder: str = "folder", doc: str = "doc") -> DataFrame:
    """(folder, docs): distinct documents filed in a folder or below."""
    return filings.join(closed, F.col(folder) == F.col("id")).groupBy(F.col("ancestor").alias("folder")).agg(F.countDistinct(doc).alias("docs"))


def shown(filings: DataFrame, closed: DataFrame, folder: str = "folder", doc: str = "doc") -> DataFrame:
    """Filings without those above another filing of the same document."""
    above = filings.join(closed.where("distance > 0"), F.col(folder) == F.col("id")).select(doc, F.col("ancestor").alias(folder)).distinct()
    return filings.join(above, [doc, folder], "left_anti")


def renumbered(rows: DataFrame, parent: str, order: str, name: str) -> DataFrame:
    """Siblings numbered from 0 in their order, equal numbers by name."""
    return rows.withColumn(order, F.row_number().over(Window.partitionBy(parent).orderBy(order, name)) - 1)


def pruned(chosen: DataFrame, locator: str = "locator", *keys: str) -> DataFrame:
    """Chosen locators without those that stand above another chosen one."""
    above = chosen.select(*keys, F.explode(ancestors(F.col(locator))).alias(locator)).distinct()
    return chosen.join(above, [*keys, locator], "left_anti")


def collapsed(nodes: DataFrame, chosen: DataFrame, locator: str = "locator") -> DataFrame:
    """Chosen leaves, with every set of leaves that is all of a node's replaced by the highest such node."""
    named = nodes.select(locator).distinct()
    inner = named.select(F.explode(ancestors(F.col(locator))).alias(locator)).distinct()
    leaves = named.join(inner, locator, "left_anti").join(chosen.select(locator, F.lit(True).alias("picked")).distinct(), locator, "left")
    under = leaves.select(F.col(locator).alias("leaf"), "picked", F.explode(F.concat(ancestors(F.col(locator)), F.array(locator))).alias("node"))
    full = under.groupBy("node").agg(F.bool_and(F.coalesce("picked", F.lit(False))).alias("all")).where("all").select(F.col("node").alias(locator)).join(named, locator, "left_semi")
    over = full.select(locator, F.explode(ancestors(F.col(locator))).alias("up"))
    lower = over.join(full.select(F.col(locator).alias("up")), "up").select(locator).distinct()
    return full.join(lower, locator, "left_anti")


def nearest_anchor(nodes: DataFrame, anchors: DataFrame, locator: str = "locator", anchor: str = "anchor") -> DataFrame:
    """Each locator with its own anchor, else that of its nearest ancestor that has one."""
    line = nodes.select(locator, F.posexplode(F.concat(ancestors(F.col(locator)), F.array(locator))).alias("depth", "up"))
    met = line.join(anchors.select(F.col(locator).alias("up"), anchor), "up")
    return nodes.select(locator).join(met.groupBy(locator).agg(F.max_by(anchor, "depth").alias(anchor)), locator, "left")
