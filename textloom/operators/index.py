"""Passage index as tables: postings with counts or 4-bit impacts, statistics, titles, and how they are stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import dropped, written

K1, B = 1.2, 0.75
LEVELS = 15
MOST_COUNT, MOST_LENGTH = 255, 65535


@dataclass
class Index:
    """postings (term, pid, tf, len), passages (pid, len, doc), dictionary (term, df)."""

    postings: DataFrame
    passages: DataFrame
    dictionary: DataFrame
    stored: bool = False  # read from a written index, where a filter on terms prunes files
    counted: DataFrame | None = None  # (h, term, pid, n, len) where units were counted in their partitions; h is the term's hash


def build(tokens: DataFrame, unit: str = "pid", term: str = "term") -> Index:
    """From one row for each token with its unit. Terms are counted once with a combining aggregate and written; the
    lengths of units and the counts of terms come from that smaller table."""
    tf = tokens.where(F.col(term).isNotNull()).groupBy(F.col(unit).alias("pid"), F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    tf = written(tf)
    lengths = tf.groupBy("pid").agg(F.least(F.sum("n"), F.lit(MOST_LENGTH)).alias("len"))
    dictionary = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(tf.select("term", "pid", F.least("n", F.lit(MOST_COUNT)).alias("tf")), lengths, dictionary)


def build_dealt(tokens: DataFrame, unit: str = "pid", term: str = "term") -> Index:
    """As build, from tokens whose texts were dealt out by `unit`: units are counted in their partitions, so that of what
    is as many as the postings nothing is shuffled, and each posting gets its unit's length there. Equal terms lie
    together in the written table, in the order of their hashes, so that a portion of the terms is read without the rest."""
    tf = tokens.where(F.col(term).isNotNull()).groupBy(F.col(unit).alias("pid"), F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    tf = tf.withColumn("len", F.least(F.sum("n").over(Window.partitionBy("pid")), F.lit(MOST_LENGTH)))
    tf = written(tf.select(F.hash("term").alias("h"), "term", "pid", "n", "len").sortWithinPartitions("h"))
    _freed(tf)
    lengths = tf.groupBy("pid").agg(F.first("len").alias("len"))
    dictionary = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(tf.select("term", "pid", F.least("n", F.lit(MOST_COUNT)).alias("tf")), lengths, dictionary, counted=tf)


def _freed(df: DataFrame) -> None:
    """The files of shuffles that nothing refers to any more go now, not when the driver's heap is full."""
    df.sparkSession._jvm.System.gc()


def statistics(passages: DataFrame) -> DataFrame:
    """One row: units, and their average length."""
    return passages.agg(F.count(F.lit(1)).alias("units"), F.avg("len").alias("avgdl"))


def idf(units: Column, df: Column) -> Column:
    return F.log(1 + (units - df + 0.5) / (df + 0.5))


def norm(length: Column, avgdl: Column) -> Column:
    return K1 * (1 - B + B * length / avgdl)


def saturation(tf: Column, norm_: Column) -> Column:
    return tf * (K1 + 1) / (tf + norm_)


def impact(tf: Column, norm_: Column) -> Column:
    """The saturated count in 15 levels, at least 1."""
    return F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.round(saturation(tf, norm_) / (K1 + 1) * LEVELS))).cast("int")


def with_impacts(index: Index) -> DataFrame:
    """postings with q instead of tf: one-row statistics are attached by a broadcast, lengths by pid."""
    joined = index.postings.join(index.passages, "pid").join(F.broadcast(statistics(index.passages)))
    return joined.select("term", "pid", impact(F.col("tf"), norm(F.col("len"), F.col("avgdl").cast("float").cast("double"))).alias("q"))


def gaps(postings: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Postings with the distance to the term's previous unit, as a compact store would keep them. A frequent term is
    split by ranges of units; the first of a range looks back to the last of the range before."""
    cut = postings.withColumn("__range", F.expr(f"pid div {span}"))
    last = cut.groupBy("term", "__range").agg(F.max("pid").alias("__last"))
    last = last.withColumn("__last", F.lag("__last").over(Window.partitionBy("term").orderBy("__range")))
    before = F.coalesce(F.lag("pid").over(Window.partitionBy("term", "__range").orderBy("pid")), F.col("__last"), F.lit(-1))
    return cut.join(last, ["term", "__range"]).withColumn("gap", F.col("pid") - before - 1).drop("__range", "__last")


PORTIONS = 4  # of the terms by their hashes, whose postings are sorted one after the other
BLOCK = 256  # units whose greatest impact is kept for each term


def _portion(counted: DataFrame, i: int) -> DataFrame:
    """Counted postings whose terms' hashes lie in the i-th of PORTIONS equal ranges."""
    first, end = (-(1 << 31) + (at << 32) // PORTIONS for at in (i, i + 1))
    return counted.where(F.col("h").between(first, end - 1)).withColumn("tf", F.least("n", F.lit(MOST_COUNT)))


def write(index: Index, path: str, buckets: int = 64) -> None:
    """Postings with impacts, sorted by term and unit inside range partitions, so that a query's terms prune files and
    row groups; the greatest impact of each term in each block of units; statistics as a manifest. What is as many as the
    postings is shuffled once, counted postings one portion of the terms after the other, and a portion's files go before the next
    begins. Counted postings end here."""
    spark = index.passages.sparkSession
    index.passages.write.mode("overwrite").parquet(f"{path}/passages")
    passages = spark.read.parquet(f"{path}/passages")
    stats, kind = statistics(passages), index.postings.schema["tf"].dataType
    portions = [index.postings.join(passages, "pid")] if index.counted is None else [_portion(index.counted, i) for i in range(PORTIONS)]
    q = impact(F.col("tf"), norm(F.col("len"), F.col("avgdl").cast("float").cast("double")))
    for i, rows in enumerate(portions):
        # Level and count go through the shuffle as one number, so that rows are short.
        rows = rows.where("pid IS NOT NULL").join(F.broadcast(stats)).select("term", "pid", (q + F.col("tf") * 16).cast("int").alias("both"))
        rows = rows.repartitionByRange(-(-buckets // len(portions)), "term", "pid").sortWithinPartitions("term", "pid")
        rows = rows.select("term", "pid", F.expr("both & 15").alias("q"), F.expr("both >> 4").cast(kind).alias("tf"), F.expr(f"pid div {BLOCK}").alias("block"))
        rows.write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        _freed(passages)
    index.dictionary.repartitionByRange(max(1, buckets // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dictionary")
    _freed(passages)
    if index.counted is not None:
        dropped(index.counted)
    kept = spark.read.parquet(f"{path}/postings")
    most = kept.groupBy("term", "block").agg(F.max("q").alias("most"))
    most.repartitionByRange(max(1, buckets // 2), "term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/blocks")
    _freed(passages)
    stats.withColumn("k1", F.lit(K1)).withColumn("b", F.lit(B)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "passages", "dictionary")), stored=True)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(term, block, most) of a written index."""
    return spark.read.parquet(f"{path}/blocks")


def describe(index: Index) -> DataFrame:
    """One row of totals: units, terms, postings, average length."""
    terms = index.dictionary.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))
    return F.broadcast(statistics(index.passages)).join(terms)
