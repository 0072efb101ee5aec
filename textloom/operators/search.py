"""Ranked search: BM25 and impact scores, required and optional terms, phrases, documents from passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import phrase_form
from ..sources.scratch import written
from .index import LEVELS, Index, idf, norm, saturation, statistics


def only(rows: DataFrame, terms: list[str], stored: bool = False) -> DataFrame:
    """Rows of the query's terms. On a stored table a filter, which prunes files; on computed terms a join with the
    few terms, for a filter would be pushed below the fold and repeat all of it."""
    if stored:
        return rows.where(F.col("term").isin(terms))
    asked = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(terms)], "term string")
    return rows.join(F.broadcast(asked), "term").select(rows.columns)  # inner: a semi-join would be pushed down too


def chosen(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the query's terms with the terms' idf; what is joined has a row for each query term."""
    known = only(index.dictionary, terms, index.stored).join(F.broadcast(statistics(index.passages)))
    known = known.select("term", idf(F.col("units"), F.col("df")).alias("idf"), "avgdl")
    return only(index.postings, terms, index.stored).join(F.broadcast(known), "term")


def missing(index: Index, terms: list[str]) -> list[str]:
    found = {r[0] for r in index.dictionary.where(F.col("term").isin(terms)).select("term").collect()}  # query terms only
    return [t for t in terms if t not in found]


def bm25(index: Index, terms: list[str], digits: int = 6) -> DataFrame:
    """(pid, score) of the units that hold any of the terms."""
    hits = chosen(index, terms).join(index.passages, "pid")
    part = F.col("idf") * saturation(F.col("tf"), norm(F.col("len"), F.col("avgdl")))
    return hits.groupBy("pid").agg(F.round(F.sum(part), digits).alias("score"))


def impacts(postings: DataFrame, index: Index, terms: list[str], digits: int = 6) -> DataFrame:
    """(pid, score) as the sum of idf times impact level; postings has q."""
    quantised = Index(postings, index.passages, index.dictionary, index.stored)
    return chosen(quantised, terms).groupBy("pid").agg(F.round(F.sum(F.col("idf") * F.col("q")), digits).alias("score"))


def required(index: Index, must: list[str], may: list[str] = (), digits: int = 6) -> DataFrame:
    """Scores of the units that hold every required term; optional terms add to them. One pass over the postings:
    counting the required terms of a unit stands for their intersection."""
    hits = chosen(index, [*must, *may]).join(index.passages, "pid")
    part = F.col("idf") * saturation(F.col("tf"), norm(F.col("len"), F.col("avgdl")))
    out = hits.groupBy("pid").agg(F.round(F.sum(part), digits).alias("score"), F.sum(F.col("term").isin(list(must)).cast("int")).alias("met"))
    return out.where(F.col("met") == len(set(must))).drop("met")


def top(scores: DataFrame, k: int, key: str = "pid", score: str = "score") -> DataFrame:
    """The k best; equal scores go by key."""
    return scores.orderBy(F.desc(score), F.asc(key)).limit(k)


def per_group(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def phrases(texts: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """Rows whose folded token string contains every phrase, stop words included."""
    form = phrase_form(F.col(text))
    spark = texts.sparkSession
    forms = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "p string").select(phrase_form(F.col("p"))).collect()]
    out = texts.withColumn("__form", form)
    for f in forms:
        out = out.where(F.contains("__form", F.lit(f)))
    return out.drop("__form")


def verified_phrases(candidates: DataFrame, texts: DataFrame, wanted: list[str], k: int, most: int = 3000, key: str = "pid") -> DataFrame:
    """Of the `most` best candidates, those that contain the phrases, and the k best of them."""
    few = top(candidates, most, key)
    return top(phrases(texts.join(few, key), wanted), k, key)


def documents(hits: DataFrame, cited: DataFrame | None = None, titles: DataFrame | None = None, title_weight: float = 0.0, authority: float = 1.0, digits: int = 6) -> DataFrame:
    """(doc, best, passages, score) from passage hits (doc, pid, score): the best passage of each document among the
    hits, plus weighted title scores and the logarithm of how often it is cited."""
    out = hits.groupBy("doc").agg(F.max("score").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "pid"))), lambda x: x["pid"]).alias("passages"))
    extra = F.lit(0.0)
    if cited is not None:
        out = out.join(cited, "doc", "left")
        extra = extra + authority * F.log10(1 + F.coalesce("cited_by", F.lit(0)))
    if titles is not None and title_weight:
        out = out.join(titles, "doc", "left")
        extra = extra + title_weight * F.coalesce("title_score", F.lit(0.0))
    return out.select("doc", "best", "passages", F.round(F.col("best") + LEVELS * extra, digits).alias("score"))


def title_scores(titles: DataFrame, terms: list[str]) -> DataFrame:
    """(doc, title_score) from rows (doc, term): the idf, among documents, of the query terms in a title, each once."""
    once = titles.distinct()
    total = once.agg(F.countDistinct("doc").alias("units"))
    known = once.where(F.col("term").isin(terms))
    weights = known.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total)).select("term", idf(F.col("units"), F.col("df")).alias("idf"))
    return known.join(F.broadcast(weights), "term").groupBy("doc").agg(F.sum("idf").alias("title_score"))


def title_only(titled: DataFrame, hits: DataFrame, scored: DataFrame, most: int = 20) -> DataFrame:
    """The strongest documents by title without a hit, each with its best own passage (doc, pid, score)."""
    alone = titled.join(hits.select("doc").distinct(), "doc", "left_anti").orderBy(F.desc("title_score"), "doc").limit(most)
    own = scored.join(F.broadcast(alone.select("doc")), "doc")
    return own.groupBy("doc").agg(F.max_by("pid", F.struct("score", -F.col("pid"))).alias("pid"), F.max("score").alias("score"))


def cited_by(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, cited_by): distinct citing documents, from mentions (doc, key) and keys (key, doc). A document does not
    cite itself, and a key that names two documents names none."""
    sure = keys.groupBy("key").agg(F.min("doc").alias("target"), F.max("doc").alias("__other")).where("target = __other").drop("__other")
    links = mentions.select(F.col("doc").alias("source"), "key").join(sure, "key").where("source <> target").select("source", "target").distinct()
    return links.groupBy(F.col("target").alias("doc")).agg(F.count(F.lit(1)).alias("cited_by"))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key), key, "left_anti")


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def materialised(rows: DataFrame, wide: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The k first of narrow rows, and only then their wide columns."""
    return F.broadcast(rows.orderBy(*order).limit(k)).join(wide, key)  # k rows


def asked_words(units: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """(key, len, words) of every unit with words: how many it has, and those that begin like a form of a term."""
    from ..functions.text import TAB_WORD, unaccent, words
    from .grammar import beginnings

    begin = rf"(?={beginnings(terms)})(?<![\p{{L}}\p{{N}}]\p{{M}}{{0,8}})[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*"
    likely = words(unaccent(F.lower(F.col(text))), begin)
    return units.select(key, F.least(F.size(words(F.col(text), TAB_WORD)), F.lit(65535)).alias("len"), likely.alias("words")).where("len > 0")


def ranked_scan(units: DataFrame, query: str, k: int, key: str = "pid", text: str = "text", digits: int = 6) -> DataFrame:
    """The k best units (key, score) of a ranked query over plain texts, without an index. Texts are read once: what
    remains of a unit is its length and the words that may be asked for; folds, counts and statistics read that."""
    from ..functions.text import query_terms, with_fold

    terms, _ = query_terms(query)
    asked = written(asked_words(units, terms, key, text))
    hits = only(with_fold(asked.select(key, "len", F.explode_outer("words").alias("word"))), terms)
    hits = hits.groupBy(key, "len", "term").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("tf"))
    stats = asked.agg(F.count(F.lit(1)).alias("units"), F.avg("len").alias("avgdl"))
    known = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats)).select("term", idf(F.col("units"), F.col("df")).alias("idf"), "avgdl")
    part = F.col("idf") * saturation(F.col("tf"), norm(F.col("len"), F.col("avgdl")))
    scores = hits.join(F.broadcast(known), "term").groupBy(key).agg(F.round(F.sum(part), digits).alias("score"))
    return top(scores, k, key)


def pruned_topk(index: Index, blocks: DataFrame, terms: list[str], k: int, first: int = 16, digits: int = 6) -> DataFrame:
    """The k best units (pid, score) by impacts in a stored index, reading few blocks of units.

    blocks has the greatest level of a term in each block of units; weighted and summed, they bound every score of the
    block. The `first` blocks of greatest bound are scored, their k-th score is a threshold, and then only blocks whose
    bound reaches it are read. The result is that of all blocks.
    """
    known = only(index.dictionary, terms, True).join(F.broadcast(statistics(index.passages))).select("term", idf(F.col("units"), F.col("df")).alias("idf"))
    known = written(known)  # a row for each query term
    bounds = written(only(blocks, terms, True).join(F.broadcast(known), "term").groupBy("block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")))
    postings = only(index.postings, terms, True).join(F.broadcast(known), "term")
    scored = lambda some: postings.join(some, "block", "left_semi").groupBy("pid").agg(F.round(F.sum(F.col("idf") * F.col("q")), digits).alias("score"))
    leading = top(bounds.withColumnRenamed("block", "pid"), first, score="bound").select(F.col("pid").alias("block"))
    sure = top(scored(leading), k).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).first()  # one row
    rest = bounds.where(F.col("bound") >= sure["least"] - 10**-digits) if sure["n"] == k else bounds
    return top(scored(rest.select("block")), k)


def with_tail(indexed: DataFrame, candidates: DataFrame | None, processed: int, key: str, order: str) -> DataFrame:
    """Rows that the index names as candidates, and all rows that it has not seen yet (order from `processed` on)."""
    done, tail = indexed.where(F.col(order) < processed), indexed.where(F.col(order) >= processed)
    return (done if candidates is None else done.join(candidates.select(key), key, "left_semi")).unionByName(tail)


def marked_hits(hits: DataFrame, key: str, loud: list[str], most: int = 100) -> DataFrame:
    """Hits (key, pos, term) to mark: those of words worth marking where a unit has any, else all; the first `most`."""
    order = Window.partitionBy(key)
    rows = hits.withColumn("__loud", F.col("term").isin(loud)).withColumn("__any", F.bool_or("__loud").over(order)).where("__loud = __any")
    return per_group(rows.drop("__loud", "__any"), key, most, F.asc("pos"))


def snippet(text: Column, at: Column, width: int = 600) -> Column:
    """A window with a third of it before a place, cut to whole words at both ends."""
    start = F.greatest(F.lit(0), at - width // 3)
    body = F.substring(text, start + 1, F.lit(width))
    body = F.when(start > 0, F.regexp_replace(body, r"^\S*\s+", "")).otherwise(body)
    return F.when(F.length(text) > start + width, F.regexp_replace(body, r"\s+\S*\z", "")).otherwise(body)


def places(rows: DataFrame, *order: Column, to: str = "place") -> DataFrame:
    """rows with their place from 1 in a total order. Ranges of the order are sorted each in its own task, and the
    counts of the ranges say where each begins."""
    cut = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)  # its upper bits are the partition, its lower ones the row there
    first, start = [], 0
    for n, many in sorted((r[0], r[1]) for r in cut.groupBy(part.alias("n")).count().collect()):  # one row for each partition
        first.append((n, start))
        start += many
    begins = cut.sparkSession.createDataFrame(first, "__part long, __first long")
    out = cut.withColumn("__part", part).join(F.broadcast(begins), "__part")
    return out.withColumn(to, F.expr("__first + (__at & 8589934591L) + 1")).drop("__at", "__part", "__first")


def systematic(rows: DataFrame, group: str, order: str, every: int, always: list = ()) -> DataFrame:
    """Every `every`-th row of each group from its first, and the rows whose `order` is in `always`. Places come from
    one sorted table, so no task holds a whole group."""
    placed = places(rows, F.asc(group), F.asc(order), to="__place")
    first = placed.groupBy(F.col(group).alias("__group")).agg(F.min("__place").alias("__first"))
    met = placed.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return met.where(((F.col("__place") - F.col("__first")) % every == 0) | F.col(order).isin(list(always))).select(rows.columns)
