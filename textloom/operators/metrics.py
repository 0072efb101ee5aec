"""Retrieval metrics, percentiles and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval(runs: DataFrame, gold: DataFrame, k: int = 20, digits: int = 3) -> DataFrame:
    """(set, queries, recall, mrr) from runs (query, doc, rank) and gold (set, query, doc); a query without gold does
    not count, one without a hit counts as 0."""
    first = gold.join(runs.where(F.col("rank") <= k), ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("rank"))
    asked = gold.select("set", "query").distinct().join(first, "query", "left")
    return asked.groupBy("set").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), digits).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), digits).alias("mrr"))


def passage_recall(runs: DataFrame, gold: DataFrame, k: int = 10, digits: int = 3) -> DataFrame:
    """Share of queries with a gold passage (query, doc, start, end) that overlaps one of the first k (half open)."""
    r = runs.where(F.col("rank") <= k).select("query", "doc", F.col("start").alias("s"), F.col("end").alias("e"))
    hit = gold.join(r, ["query", "doc"]).where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))).select("query").distinct().withColumn("hit", F.lit(1.0))
    return gold.select("query").distinct().join(hit, "query", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), digits).alias("recall"))


def nearest_percentile(rows: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """sorted[min(floor(p n), n - 1)] of each key, from counts of equal values, so no task sorts a whole key's rows."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = counted.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    at = F.least(F.floor(F.col("total") * p), F.col("total") - 1)
    hit = ranked.where((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at))
    return hit.select(*keys, F.col(value).alias("percentile"))


def report(rows: DataFrame, group: Column, *measures: Column) -> DataFrame:
    """A table by group with a total."""
    return rows.select("*", group.alias("grp")).rollup("grp").agg(*measures).withColumn("grp", F.coalesce("grp", F.lit("total")))


def majority_split(rows: DataFrame, group: str, *conditions: tuple[str, Column]) -> DataFrame:
    return rows.groupBy(group).agg(*[F.sum(c.cast("int")).alias(name) for name, c in conditions])


def receipts(cases: DataFrame, family: str, checks: dict[str, Column]) -> DataFrame:
    """(family, cases, passed, failed_…) of evaluated cases: a case passes if all its checks hold; an unknown check fails."""
    held = {name: F.coalesce(c, F.lit(False)) for name, c in checks.items()}
    every = F.lit(True)
    for c in held.values():
        every = every & c
    failed = [F.sum((~c).cast("int")).alias(f"failed_{name}") for name, c in held.items()]
    return cases.groupBy(family).agg(F.count(F.lit(1)).alias("cases"), F.sum(every.cast("int")).alias("passed"), *failed)


def resolution_audit(asked: DataFrame, found: DataFrame, key: str, family: str) -> DataFrame:
    """(family, exact, consolidated, wrong, ambiguous, missing) of requests (key, family, expected, consolidated) and
    what they resolved to (key, id): one id that is expected, one that the expected instrument was consolidated into,
    another one, several, none."""
    ids = found.groupBy(key).agg(F.min("id").alias("__low"), F.max("id").alias("__high"))
    rows = asked.join(ids, key, "left")
    several, one = F.col("__low") < F.col("__high"), F.col("__low") == F.col("__high")
    exact = one & F.col("__low").eqNullSafe(F.col("expected"))
    later = one & ~exact & F.col("__low").eqNullSafe(F.col("consolidated"))
    kinds = {"exact": exact, "consolidated": later, "wrong": one & ~exact & ~later, "ambiguous": several, "missing": F.col("__low").isNull()}
    return rows.groupBy(family).agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(name) for name, c in kinds.items()])
