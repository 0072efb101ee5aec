"""Exhaustive nearest vectors: exact and 8-bit cosine, votes of the neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (length(a) * length(b))


def quantised(a: Column) -> Column:
    """Struct of 8-bit components of the unit vector and the inverse length of what they hold."""
    unit = length(a)
    q = F.transform(a, lambda x: F.round(x.cast("double") / unit * 127).cast("tinyint"))
    return F.struct(q.alias("q"), (1 / length(q)).cast("float").alias("inverse"))


QUERIES = 1000  # that one task holds at a time


def search(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", digits: int = 6) -> DataFrame:
    """The k best rows for each of a stated set of queries (query_key, query): every row is scored, and nothing but
    (query, key, score) is ranked. Up to QUERIES of them are sent to all tasks; more go in blocks, which the rows meet
    one after another."""
    many = queries.count()
    if many <= QUERIES:
        met = rows.join(F.broadcast(queries))
    else:
        blocks = -(-many // QUERIES)
        block = F.pmod(F.xxhash64(query_key), F.lit(blocks)).cast("int")
        met = rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(queries.withColumn("__block", block), "__block")
    scored = met.select(query_key, key, F.round(cosine(F.col("query"), F.col(vector)), digits).alias("score"))
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def window_maximum(scores: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """What the best window of a passage scores, and how many windows it has."""
    return scores.groupBy(*keys).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("windows"))


def reranked(candidates: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Candidates in order of a new score, equal ones by key; scores that are no finite numbers are refused."""
    bad = candidates.where(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")))
    if not bad.isEmpty():
        raise ValueError(f"{score} must be finite")
    return candidates.orderBy(F.desc(score), F.asc(key))


def dense_first(units: DataFrame, group: str, score: str, key: str, most: int = 96) -> DataFrame:
    """The units that go to a costlier ranking: all of a group up to `most`, else the best `most` by their dense score."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(key)))
    return units.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def quantised_scores(rows: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(key, score) with 8-bit rows and an exact unit query."""
    size = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(x / size) for x in query])
    packed = rows.select(key, quantised(F.col(vector)).alias("v"))
    return packed.select(key, F.round(dot(q, F.col("v.q")) * F.col("v.inverse").cast("double"), digits).alias("score"))


def vote(neighbours: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "label", query_key: str = "query_id") -> DataFrame:
    """The most frequent label among the neighbours; equal votes go to the smaller label."""
    counted = neighbours.join(labels.select(key, label), key).groupBy(query_key, label).agg(F.count(F.lit(1)).alias("votes"))
    return counted.groupBy(query_key).agg(F.max_by(label, F.struct("votes", -F.col(label))).alias("winner"), F.max("votes").alias("votes"))


def margin(probabilities: Column) -> Column:
    """Difference of the two greatest values of a map."""
    ranked = F.array_sort(F.map_values(probabilities), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    return F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))
