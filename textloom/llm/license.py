"""License scans by an exact set-similarity join, with DataFrame and SQL functions only.

A text's blocks are its runs of consecutive words, SPREAD times as long as the template, whatever lines they stand on.
A template matches where at least `threshold` of its distinct words stand in one block.

Template words are put in one global order, rarest in the corpus first (they are counted in all texts). An inverted
index lists every template under its words, with their places in that order. One pass finds which template words each
text holds; only texts that hold a word of some prefix, the first |T| - need + 1 words of a template, send them to the
index. A text and a template go on when their first shared word lies in the prefix, so that enough words may follow it (prefix and positional
filter), and when they share `need` words at all (length filter); then the words inside the blocks are counted exactly.

Apart from that, fixed phrases are located word by word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Phrases whose places are listed, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Openings and notices of public licenses, as their authors publish them.
TEMPLATES = {
    "agpl-3.0": "gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-terms": "you may not use this file except in compliance with the license",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "gnu lesser general public license as published by the free software foundation",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.9  # share of the words of a template
SPREAD = 1.5  # length of a block in words, times that of the template
KEYS = 1_000_000  # texts whose keys, of 16 bytes each, are sent to every task
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower(col: Column) -> Column:
    """Only A-Z in lower case, as the words are defined."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_keys() -> list[Column]:
    """Two hashes that name a row (id, body); equal rows share a result."""
    return [F.xxhash64("id", "body").alias("k1"), F.xxhash64("body", "id", F.lit("second")).alias("k2")]


def word_list(col: Column) -> Column:
    return F.filter(F.split(lower(col), GAP), lambda w: w != "")


def places(words: Column, phrase: str) -> Column:
    """Starts of a phrase among the words."""
    parts = phrase.split()
    hit = lambda i: F.forall(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(p).alias("p")) for j, p in enumerate(parts)]), lambda x: F.get(words, i + x["j"]) == x["p"])
    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), hit)).otherwise(F.array().cast("array<int>"))


def word_counts(scanned: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each of the given words stands."""
    own = scanned.select(F.explode("vocabulary").alias("word"))
    return dict.fromkeys(vocabulary, 0) | {r[0]: r[1] for r in own.groupBy("word").count().collect()}


def needed(words: int, threshold: float) -> int:
    """How many of a template's distinct words make a match."""
    return max(1, math.ceil(threshold * words - 1e-9))


def template_index(counts: dict[str, int], templates: dict[str, str], threshold: float) -> list[dict]:
    """For each template with any words: its distinct words in global order, how many are needed, its prefix and its
    block's length."""
    out = []
    for label, text in templates.items():
        words = sorted(set(text.split()), key=lambda w: (counts[w], w))
        if words:
            need = needed(len(words), threshold)
            out.append({"label": label, "words": words, "need": need, "prefix": len(words) - need + 1, "block": math.ceil(SPREAD * len(text.split()))})
    return out


def matches(docs: DataFrame, scanned: DataFrame, templates: dict[str, str], vocabulary: list[str], threshold: float) -> DataFrame:
    """Rows (k1, k2, label, part) of the texts, named by two key columns, and the templates that one of their blocks holds.

    scanned (k1, k2, vocabulary) has the template words of each text. Texts are read again only where the filters leave
    them: their keys go to all tasks up to KEYS, beyond that only the places of their words are shuffled.
    """
    spark = docs.sparkSession
    index = template_index(word_counts(scanned, vocabulary), templates, threshold)
    schema = "word string, label string, place int, of int, need int, prefix int"
    inverted = spark.createDataFrame([(w, t["label"], i, len(t["words"]), t["need"], t["prefix"]) for t in index for i, w in enumerate(t["words"])], schema)
    listed = spark.createDataFrame([(t["label"], t["words"], t["words"][: t["prefix"]], t["block"]) for t in index], "label string, words array<string>, lead array<string>, block int")
    lead = [w for t in index for w in t["words"][: t["prefix"]]]
    some = scanned.where(F.arrays_overlap("vocabulary", F.array(*map(F.lit, sorted(set(lead)))))) if lead else scanned.where("false")
    met = some.select("k1", "k2", F.explode("vocabulary").alias("word")).distinct().join(F.broadcast(inverted), "word")
    met = met.groupBy("k1", "k2", "label").agg(F.count(F.lit(1)).alias("shared"), F.min("place").alias("first"), F.first("of").alias("of"), F.first("need").alias("need"), F.first("prefix").alias("prefix"))
    met = written(met.where("first < prefix AND shared >= need").select("k1", "k2", "label", "of", "need"), "candidates")
    keys = written(met.select("k1", "k2").distinct(), "keys")
    placed = lambda rows: rows.withColumn("hits", F.filter(F.transform(word_list(F.col("body")), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(vocabulary)))
    named = docs.select(*row_keys(), "body")
    hits = placed(named.join(F.broadcast(keys), ["k1", "k2"])) if keys.count() <= KEYS else placed(named.where("body <> ''")).drop("body").join(keys, ["k1", "k2"])
    hits = hits.groupBy("k1", "k2").agg(F.first("hits").alias("hits"))
    own = met.join(F.broadcast(listed), "label").join(hits, ["k1", "k2"]).withColumn("hits", F.filter("hits", lambda x: F.array_contains("words", x["word"])))
    # A block that matches holds a word of the prefix, so only places near one are looked at.
    rare = F.transform(F.filter("hits", lambda x: F.array_contains("lead", x["word"])), lambda x: x["at"])
    own = own.withColumn("rare", rare).withColumn("hits", F.filter("hits", lambda x: F.exists("rare", lambda p: F.abs(p - x["at"]) < F.col("block"))))
    # A block holds no more hits than words, so the hits of the block that starts with one lie among the next `block`.
    inside = lambda i: F.filter(F.slice("hits", i + 1, F.col("block")), lambda x: x["at"] < F.get("hits", i)["at"] + F.col("block"))
    most = F.array_max(F.transform(F.sequence(F.lit(0), F.size("hits") - 1), lambda i: F.size(F.array_distinct(F.transform(inside(i), lambda x: x["word"])))))
    counted = written(own.where("size(hits) >= need").select("k1", "k2", "label", "of", "need", most.alias("most")), "counted")
    return counted.where("most >= need").select("k1", "k2", "label", (F.col("most") / F.col("of")).alias("part"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of PHRASES, first_word and last_word are their least and greatest start (null without
    any). labels adds the templates of which a block holds at least `threshold`. score is 1 where a phrase stands,
    else the greatest containment that met the threshold, else 0. A null or empty text has no words and score 0;
    equal and repeated rows are judged each, and alike; null ids stay; texts of any length are scanned whole. Other
    columns of docs, whatever their names, are ignored. An empty table gives no rows, a template without words
    matches nothing.
    """
    templates = TEMPLATES if templates is None else templates
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    body, split = F.col("body"), F.col("split")
    # One pass over all texts: what of it is needed later is written, a row of a few numbers and words for each text.
    cut = docs.select("id", *row_keys(), "body", F.split(lower(body), GAP).alias("split"))
    empty = F.when(F.get(split, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(split) > 1) & (F.element_at(split, -1) == ""), 1).otherwise(0)
    words = F.when(body.rlike("(?i)" + "|".join(GAP.join(p.split()) for p in PHRASES)), F.filter(split, lambda w: w != ""))
    held = F.array_intersect(split, F.array(*map(F.lit, vocabulary))) if vocabulary else F.array().cast("array<string>")
    rows = cut.select("id", "k1", "k2", (F.size(split) - empty).cast("long").alias("n_words"), words.alias("words"), held.alias("vocabulary"))
    at = lambda label: lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))
    starts = F.concat(*[F.transform(places(F.col("words"), p), at(label)) for p, label in PHRASES.items()])
    none = F.array().cast("array<struct<at:int,label:string>>")
    rows = written(rows.select("id", "k1", "k2", "n_words", "vocabulary", F.when(F.col("words").isNotNull(), starts).otherwise(none).alias("starts")), "scanned")
    found = matches(docs, rows.select("k1", "k2", "vocabulary"), templates, vocabulary, threshold).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("part").alias("part"))
    rows = rows.join(found, ["k1", "k2"], "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts.at").cast("long").alias("first_word"),
        F.array_max("starts.at").cast("long").alias("last_word"),
        joined(F.col("starts.label")).alias("base_labels"),
        joined(F.concat(F.col("starts.label"), F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
    )


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same scan in DuckDB SQL, without any filter."""
    templates = TEMPLATES if templates is None else templates
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    quoted = lambda items: ", ".join("'" + x + "'" for x in items)
    values = ", ".join(f"('{label}', [{quoted(sorted(set(t.split())))}], {needed(len(set(t.split())), threshold)}, {math.ceil(SPREAD * len(t.split()))})" for label, t in templates.items())
    phrases = ", ".join(f"([{quoted(p.split())}], '{label}')" for p, label in PHRASES.items())
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{word}') AS words FROM d),
t(label, words, need, block) AS (VALUES {values}),
p(words, label) AS (VALUES {phrases}),
s AS (SELECT r, unnest(generate_series(1, len(words))) AS i, words FROM w WHERE regexp_matches(low, 'license|cc')),
b AS (SELECT r, s.i - 1 AS pos, p.label FROM s JOIN p ON s.words[s.i] = p.words[1] AND s.words[s.i:s.i + len(p.words) - 1] = p.words),
bs AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY r),
v AS (SELECT label, need, block, len(words) AS size, unnest(words) AS word FROM t),
x AS (SELECT r, unnest(words) AS word, unnest(generate_series(1, len(words))) AS pos FROM w),
h AS (SELECT r, label, need, block, size, pos, x.word FROM x JOIN v ON v.word = x.word),
k AS (SELECT r, label, need, size, count(DISTINCT word) OVER (PARTITION BY r, label ORDER BY pos RANGE BETWEEN CURRENT ROW AND block - 1 FOLLOWING) AS held FROM h),
m AS (SELECT r, label, max(held) / max(size) AS part FROM k WHERE held >= need GROUP BY r, label),
ms AS (SELECT r, max(part) AS part, list(DISTINCT label) AS labels FROM m GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
 coalesce(array_to_string(list_sort(bs.labels), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ms.labels, [])))), ','), '') AS labels,
 CASE WHEN n > 0 THEN 1.0 ELSE coalesce(part, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bs USING (r) LEFT JOIN ms USING (r)"""
