"""Resolving keys: unique or abstain, cascades of keys, merges of records, routed and ambiguous keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import loose_title, similar_titles, title_key

# Rank of a collection's path; consolidated texts come first.
PATH_RANK = {"stat": 0, "regu": 1, "const": 2, "hstat": 3, "astat": 4}
OTHER_RANK = 9


def unique(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that name exactly one value; the others are left out. Counts combine before they are shuffled."""
    return rows.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__other")).where(f"`{value}` = __other").drop("__other")


def ambiguous(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(value).alias("values")).where("values > 1")


def first_of(rows: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def path_rank(path: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in PATH_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(ranks, path), F.lit(OTHER_RANK))


def chosen(candidates: DataFrame, key: str) -> DataFrame:
    """One instrument among the candidates (key, id, path, title, wanted) of each key, or none: the one id of the best
    path rank, else the one whose title is wanted there, else the one whose title is wanted at all."""
    w = Window.partitionBy(key)
    rows = candidates.withColumn("rank", path_rank(F.col("path"))).withColumn("best", F.min("rank").over(w))
    inside = F.when(F.col("rank") == F.col("best"), F.col("id"))
    titled = F.when((F.col("title") == F.col("wanted")) & (F.col("wanted") != ""), F.col("id"))
    both = F.when(F.col("rank") == F.col("best"), titled)
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    return rows.groupBy(key).agg(F.coalesce(one(inside), one(both), one(titled)).alias("id")).where("id is not null")


def cascade(steps: list[DataFrame], key: str) -> DataFrame:
    """Of steps (key, id), each tried for the keys that those before it left open: (key, id, step)."""
    tagged = [s.select(key, "id", F.lit(i).alias("step")) for i, s in enumerate(steps)]
    return first_of(reduce(DataFrame.unionByName, tagged), key, order=[F.col("step"), F.col("id")])


def legislation(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(request, id, step): citation key, then candidate ids, then the exact and the loose title; a title must fit what
    is found. requests: request, title, keys, ids, jurisdiction; index: id, database, path, key, title (a title key)."""
    asked = requests.withColumn("wanted", title_key(F.col("title"))).withColumn("loose", loose_title(F.col("title")))
    rows = index.withColumn("loose_title", loose_title(F.col("title")))
    by = lambda source, column: asked.select("request", "wanted", F.explode(source).alias("__k")).join(rows.withColumnRenamed(column, "__k") if column == "key" else rows.withColumn("__k", F.col(column)), "__k")
    found = []
    for source, column in (("keys", "key"), ("ids", "id")):
        met = by(source, column).select("request", "wanted", "id", "path", "title")
        one = chosen(met, "request").join(met.select("request", "id", "title", "wanted"), ["request", "id"])
        found.append(one.where(similar_titles(F.col("title"), F.col("wanted"))).select("request", "id").distinct())
    for mine, theirs in (("wanted", "title"), ("loose", "loose_title")):
        pool = asked.where(F.col("wanted") != "").select("request", F.col(mine).alias("__t"), "jurisdiction").join(rows.withColumn("__t", F.col(theirs)), "__t")
        pool = pool.where(F.col("jurisdiction").isNull() | F.startswith("database", "jurisdiction"))
        found.append(unique(pool.select("request", "id"), "request", "id"))
    return cascade(found, "request")


def merged_records(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """All keys of both; the target's fields win where they are set."""
    fields = [c for c in dict.fromkeys([*target.columns, *source.columns]) if c != key]
    t, s = target.alias("t"), source.alias("s")
    pick = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("t", target), ("s", source)) if c in df.columns]).alias(c)
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full").select(F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key), *map(pick, fields))


def merged_maps(ours: Column, theirs: Column) -> Column:
    """Both maps in one; theirs wins."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(ours, empty), F.coalesce(theirs, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def plausible(rows: DataFrame, base_year: str = "base_year", year: str = "year", base_court: str | None = None, court: str | None = None) -> DataFrame:
    """Rows whose target can be meant: its year is at most one off, and, where courts are given, a decision of the
    Supreme Court (SCC, CSC) only stands for one of that court."""
    near = rows.where(F.abs(F.col(base_year) - F.col(year)) <= 1)
    if base_court is None or court is None:
        return near
    supreme = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin("scc", "csc")
    return near.where(supreme(base_court) == supreme(court))


def labelled(rows: DataFrame, *keys: str, label: str = "label", year: str = "year") -> DataFrame:
    """One row for each key: its longest label, of equal ones the first in order, and its earliest year."""
    return rows.groupBy(*keys).agg(F.min_by(label, F.struct(-F.length(label), label)).alias(label), F.min(year).alias(year))


def united(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both corpora under one key with `corpus` 1 or 2; a key of both is taken from the first. Repeated keys stay."""
    return first.withColumn("corpus", F.lit(1)).unionByName(second.join(first.select(key).distinct(), key, "left_anti").withColumn("corpus", F.lit(2)))
