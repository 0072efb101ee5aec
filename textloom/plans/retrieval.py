"""Queries on analyzers, the index, ranked, boolean and proximity search, spans and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import grammar, index, metrics, nearest, passages, search
from ..sources import readers
from ..sources.scratch import folder
from .catalog import query

ASKED = "apache license version of the thering"
TERMS, LOUD = tx.query_terms(ASKED)
_LIST = ", ".join(f"'{t}'" for t in TERMS)
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def folded(source: str) -> str:
    """SQL: source's columns and `term`, the light fold of `word`."""
    return f"""(SELECT * EXCLUDE (w0, w1, w2), CASE WHEN length(w2) > 4 AND w2 LIKE '%e' THEN left(w2, -1) ELSE w2 END AS term FROM (
 SELECT *, CASE WHEN length(w1) > 5 AND w1 LIKE '%ing' THEN left(w1, -3) WHEN length(w1) > 4 AND w1 LIKE '%ed' AND w1 NOT LIKE '%eed' THEN left(w1, -2) ELSE w1 END AS w2 FROM (
 SELECT *, CASE WHEN length(w0) > 4 AND w0 LIKE '%ies' AND NOT regexp_matches(w0, '[ae]ies$') THEN left(w0, -3) || 'y'
  WHEN length(w0) > 4 AND w0 LIKE '%aux' THEN left(w0, -3) || 'al'
  WHEN length(w0) > 3 AND regexp_matches(w0, '(?:eau|eu|au)x$') THEN left(w0, -1)
  WHEN length(w0) > 3 AND w0 LIKE '%es' AND NOT regexp_matches(w0, '[aeo]es$') THEN left(w0, -1)
  WHEN length(w0) > 3 AND w0 LIKE '%s' AND NOT regexp_matches(w0, '(?:us|ss|is)$') THEN left(w0, -1) ELSE w0 END AS w1 FROM (
 SELECT *, translate(lower(word), '{tx.ACCENTED}', '{tx.PLAIN}') AS w0 FROM {source}))))"""


TOKENS = f"""tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents)),
ft AS MATERIALIZED (SELECT doc_id, word, pos, term FROM {folded("tok")})"""
LINES = "ln AS (SELECT doc_id, para, line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS para FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line) <> '')"
LINE_TOKENS = f"""{LINES}, lt AS (SELECT doc_id, para, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, para, regexp_extract_all(line, '{WORD}') AS ws FROM ln)),
ft AS MATERIALIZED (SELECT doc_id, para, word, pos, term FROM {folded("lt")})"""


def bm25_sql(units: str, key: str, limit: int = 10) -> str:
    """units names a relation (key, term)."""
    return f"""tf AS (SELECT {key}, term, least(count(*), 255) AS tf FROM {units} GROUP BY ALL),
len AS (SELECT {key}, least(count(*), 65535) AS len FROM {units} GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len) AS l FROM len),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st WHERE term IN ({_LIST}) GROUP BY term, n)
SELECT {key}, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / l))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING ({key}), st
GROUP BY {key} ORDER BY score DESC, {key} LIMIT {limit}"""


def doc_tokens(t):
    return tx.with_fold(tx.exploded(t("documents"), "doc_id"))


def line_tokens(t, tree=None):
    """Tokens (doc, para, sent, pos, word, term); a sentence ends with a word that has . ! or ? after it. With a query's
    tree, only those of lines that can hold a word of it."""
    lines = passages.lines(t("documents"), F.col("doc_id").alias("doc"))
    lines = lines if tree is None else grammar.lines_with(lines, tree)
    # Places are known inside the line: the words of each sentence, and how many come before it.
    found = F.transform(F.split("line", "[.!?]"), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    rows = lines.select("doc", "para", found.alias("found"))
    before = F.transform(F.sequence(F.lit(0), F.size("found") - 1), lambda i: F.aggregate(F.slice("found", F.lit(1), i), F.lit(0), lambda n, s: n + F.size(s)))
    rows = rows.select("doc", "para", F.posexplode_outer(F.arrays_zip("found", before.alias("before"))).alias("sent", "s"))
    rows = rows.select("doc", "para", "sent", F.col("s.before").alias("before"), F.posexplode_outer("s.found").alias("at", "word")).where("word IS NOT NULL")
    return tx.with_fold(rows.select("doc", "para", "sent", (F.col("before") + F.col("at")).alias("pos"), "word"))


# The same tokens in SQL, with sentences.
SENTENCE_TOKENS = rf"""{LINES}, raw AS (SELECT doc_id, para, unnest(ws) AS word, generate_subscripts(ws, 1) AS nth FROM (SELECT doc_id, para, regexp_extract_all(line, '{WORD}|[.!?]') AS ws FROM ln)),
lt AS (SELECT doc_id, para, word, sent, pos FROM (SELECT doc_id, para, word, sum((word IN ('.', '!', '?'))::INT) OVER w AS sent, sum((word NOT IN ('.', '!', '?'))::INT) OVER w - 1 AS pos FROM raw WINDOW w AS (PARTITION BY doc_id, para ORDER BY nth ROWS UNBOUNDED PRECEDING)) WHERE word NOT IN ('.', '!', '?')),
ft AS MATERIALIZED (SELECT doc_id, para, sent, pos, word, term FROM {folded("lt")})"""


@query("SELECT doc_id::VARCHAR AS row_id, coalesce(nullif(text, ''), '') AS text_en, '' AS text_fr, '' AS title, '' AS citation, '' AS date, coalesce(nullif(source, ''), '') AS dataset, '' AS url, '' AS license, '' AS speaker, '' AS title_fr, '' AS citation_fr, '' AS url_fr, '' AS date_fr FROM documents")
def scan_projection(spark, t):
    return readers.projected(t("documents"))


@query(raw=True)
def row_identity(spark, t):
    docs = t("documents")
    return docs.select("doc_id", F.col("_metadata.row_index").alias("row_index"), F.sha2(F.concat_ws("|", "_metadata.file_name", F.col("_metadata.file_size").cast("string")), 256).alias("file_id"))


@query("SELECT count(*) AS n FROM documents")
def row_count(spark, t):
    return t("documents").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 50 AND NOT regexp_matches(left(text, 5000), '(?i)apache license')")
def head_exclusion(spark, t):
    kept = t("documents").where((F.length(F.trim("text")) >= 50) & ~F.substring("text", 1, 5000).rlike("(?i)apache license"))
    return kept.select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE source = 'src1' OR (source LIKE 'src1%' AND NOT (source IN ('src11', 'src12') AND regexp_matches(left(text, 5000), '(?i)license')))")
def dataset_config(spark, t):
    return readers.configured(t("documents").withColumnRenamed("source", "dataset"), ["src1", "src1*"], exclude=[(["src11", "src12"], "license")]).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 7 = 0 OR doc_id IN (3, 5, 8)")
def systematic_sample(spark, t):
    return search.systematic(t("documents").select("doc_id", "source"), "source", "doc_id", 7, [3, 5, 8]).select("doc_id")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS pieces FROM documents")
def tokens_count(spark, t):
    return t("documents").select("doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("words"), F.size(tx.words(F.col("text"), r"[^ \t\n\r]+")).cast("long").alias("pieces"))


@query(f"WITH {TOKENS} SELECT doc_id, term, least(count(*), 255)::BIGINT AS tf FROM ft GROUP BY doc_id, term")
def token_tf(spark, t):
    return doc_tokens(t).groupBy("doc_id", "term").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("tf"))


@query(f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS n FROM ft GROUP BY term")
def doc_freq(spark, t):
    tf = doc_tokens(t).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))


@query(f"WITH {TOKENS} SELECT DISTINCT word, term FROM ft")
def fold_terms(spark, t):
    return tx.with_fold(tx.exploded(t("documents"), "doc_id").select("word").distinct()).select("word", "term")


@query(f"WITH {TOKENS}, {bm25_sql('ft', 'doc_id')}")
def bm25_topk(spark, t):
    return search.ranked_scan(t("documents"), ASKED, 10, "doc_id")


@query(f"WITH {LINE_TOKENS}, u AS (SELECT doc_id::BIGINT * 1048576 + para AS pid, term FROM ft), {bm25_sql('u', 'pid', 20)}")
def bm25_by_line(spark, t):
    lines = passages.lines(t("documents"), "doc_id")
    units = lines.select((F.col("doc_id").cast("long") * (1 << 20) + F.col("para")).alias("pid"), F.col("line").alias("text")).where(F.size(tx.words(F.col("text"))) > 0)
    return search.ranked_scan(units, ASKED, 20)


IMPACTS = f"""{TOKENS}, tf AS (SELECT doc_id AS pid, term, least(count(*), 255) AS tf FROM ft GROUP BY ALL), len AS (SELECT doc_id AS pid, least(count(*), 65535) AS len FROM ft GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len)::FLOAT::DOUBLE AS l FROM len),
im AS (SELECT term, pid, greatest(1, least(15, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / l)) / 2.2 * 15)))::INT AS q FROM tf JOIN len USING (pid), st)"""


def _impacts(t):
    built = index.build(doc_tokens(t), "doc_id")
    return built, index.with_impacts(built)


@query(f"WITH {IMPACTS}, df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st WHERE term IN ({_LIST}) GROUP BY term, n) SELECT pid, round(sum(idf * q), 6) AS score FROM im JOIN df USING (term) GROUP BY pid ORDER BY score DESC, pid LIMIT 100")
def impact_topk(spark, t):
    built, postings = _impacts(t)
    return search.top(search.impacts(postings, built, TERMS), 100)


_STORED: dict[tuple, str] = {}
FINER = 8  # partitions of postings for one of the scan: a posting takes more memory than its word in a file


def stored(spark, t) -> str:
    """The place of the stored index of a session's documents, written at the first call."""
    known = (spark.sparkContext.applicationId, t.place)
    if known not in _STORED:
        place, docs = folder(spark), t("documents").select("doc_id", "text")
        parts = max(4, spark.sparkContext.defaultParallelism, FINER * docs.rdd.getNumPartitions())
        tokens = tx.with_fold(tx.exploded(docs.repartition(parts, "doc_id"), "doc_id"))
        index.write(index.build_dealt(tokens, "doc_id"), place, parts)
        _STORED[known] = place
    return _STORED[known]


@query(f"WITH {IMPACTS}, df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st WHERE term IN ({_LIST}) GROUP BY term, n) SELECT pid, round(sum(idf * q), 6) AS score FROM im JOIN df USING (term) GROUP BY pid ORDER BY score DESC, pid LIMIT 10")
def stored_index_topk(spark, t):
    """Top units read from a stored index, pruned by the maxima of its blocks."""
    place = stored(spark, t)
    return search.pruned_topk(index.read(spark, place), index.read_blocks(spark, place), TERMS, 10)


@query(f"WITH {TOKENS}, {bm25_sql('ft', 'doc_id', 10).replace('SELECT doc_id, round', 'SELECT doc_id AS pid, round')}")
def stored_index_bm25(spark, t):
    return search.top(search.bm25(index.read(spark, stored(spark, t)), TERMS), 10)


@query(f"WITH {IMPACTS} SELECT term, pid, q FROM im WHERE term IN ({_LIST})")
def impact_levels(spark, t):
    _, postings = _impacts(t)
    return search.only(postings, TERMS)


@query(f"WITH {TOKENS}, p AS (SELECT DISTINCT term, doc_id AS pid FROM ft WHERE term IN ({_LIST})) SELECT term, pid, pid - coalesce(lag(pid) OVER (PARTITION BY term ORDER BY pid), -1) - 1 AS gap FROM p")
def postings_gaps(spark, t):
    built = index.build(doc_tokens(t), "doc_id")
    return index.gaps(search.only(built.postings, TERMS).select("term", "pid"))


@query(f"WITH {TOKENS}, tf AS (SELECT doc_id, term, count(*) AS n FROM ft GROUP BY ALL) SELECT (SELECT count(DISTINCT doc_id) FROM tf)::BIGINT AS units, (SELECT round(avg(least(l, 65535)), 6) FROM (SELECT sum(n) AS l FROM tf GROUP BY doc_id)) AS avgdl, count(DISTINCT term)::BIGINT AS terms, count(*)::BIGINT AS postings FROM tf")
def index_stats(spark, t):
    return index.describe(index.build(doc_tokens(t), "doc_id")).select("units", F.round("avgdl", 6).alias("avgdl"), "terms", "postings")


PASSAGES = f"""WITH {LINE_TOKENS}, u AS (SELECT doc_id, doc_id::BIGINT * 1048576 + para AS pid, term FROM ft),
tf AS (SELECT pid, doc_id, term, least(count(*), 255) AS tf FROM u GROUP BY ALL), len AS (SELECT pid, least(count(*), 65535) AS len FROM u GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len) AS l FROM len),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st WHERE term IN ({_LIST}) GROUP BY term, n),
hit AS (SELECT doc_id AS doc, pid, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / l))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (pid), st GROUP BY ALL ORDER BY score DESC, pid LIMIT 100)"""


def _line_hits(t, k: int = 100):
    tokens = tx.with_fold(tx.exploded(passages.lines(t("documents"), "doc_id"), "doc_id", "para", text="line"))
    units = tokens.select((F.col("doc_id").cast("long") * (1 << 20) + F.col("para")).alias("pid"), "term")
    hits = search.top(search.bm25(index.build(units), TERMS), k)
    return hits.withColumn("doc", F.expr("pid div 1048576"))


@query(f"{PASSAGES} SELECT doc, max(score) AS best, list(pid ORDER BY score DESC, pid)::VARCHAR AS passages FROM hit GROUP BY doc")
def doc_from_passages(spark, t):
    out = search.documents(_line_hits(t))
    return out.select("doc", "best", F.concat(F.lit("["), F.array_join(F.col("passages").cast("array<string>"), ", "), F.lit("]")).alias("passages"))


@query(f"{PASSAGES} SELECT doc, pid, score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, pid) AS n FROM hit) WHERE n <= 2")
def two_passages_each(spark, t):
    return search.per_group(_line_hits(t), "doc", 2, F.desc("score"), F.asc("pid")).select("doc", "pid", "score")


CITED = """cit AS (SELECT d.doc_id AS source, b.item_id AS target FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE d.doc_id <> b.item_id), cb AS (SELECT target AS doc, count(DISTINCT source) AS cited_by FROM cit GROUP BY target)"""


@query(f"WITH {CITED} SELECT doc::BIGINT AS doc, cited_by::BIGINT AS cited_by, round(15 * log10(1 + cited_by), 6) AS authority FROM cb")
def authority_rank(spark, t):
    docs = t("documents").select("doc_id", "text")
    items = t("benchmark").select(F.col("item_id").cast("long").alias("key"), F.col("text").alias("item"))
    first = F.regexp_extract("item", WORD, 0)
    words = docs.select("doc_id", "text", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word"))
    met = words.join(items.withColumn("word", first), "word").where(F.contains("text", F.col("item")))
    mentions = met.select(F.col("doc_id").alias("doc"), "key").distinct()
    cited = search.cited_by(mentions, items.select("key", F.col("key").alias("doc")))
    return cited.select("doc", "cited_by", F.round(15 * F.log10(1 + F.col("cited_by")), 6).alias("authority"))


FORM = f"' ' || array_to_string(regexp_extract_all(lower(translate(text, '{tx.ACCENTED}', '{tx.PLAIN}')), '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), ' ') || ' '"


@query(f"SELECT doc_id FROM documents WHERE contains({FORM}, ' apache license version ') AND contains({FORM}, ' licensed under the ')")
def phrase_search(spark, t):
    return search.phrases(t("documents"), ["Apache License, Version", "Licensed under the"]).select("doc_id")


@query(f"""WITH {TOKENS}, tf AS (SELECT doc_id AS pid, term, least(count(*), 255) AS tf FROM ft GROUP BY ALL), len AS (SELECT doc_id AS pid, least(count(*), 65535) AS len FROM ft GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len) AS l FROM len),
df AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st WHERE term IN ('licens', 'under', 'apach', 'mit') GROUP BY term, n)
SELECT pid, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / l))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (pid), st GROUP BY pid HAVING sum((term IN ('licens', 'under'))::INT) = 2""")
def optional_required_terms(spark, t):
    return search.required(index.build(doc_tokens(t), "doc_id"), ["licens", "under"], ["apach", "mit"])


@query("""WITH p AS (SELECT doc_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)?')) AS ws FROM documents)
SELECT doc_id FROM p WHERE (list_contains(ws, 'license') AND contains(low, 'version 2.0') AND NOT list_contains(ws, 'the')) OR (list_contains(ws, 'mit') AND len(list_filter(ws, lambda w: starts_with(w, 'releas'))) > 0)""")
def boolean_and_or_not(spark, t):
    rows = t("documents").select("doc_id", "text", F.array_distinct(tx.words(F.lower("text"), tx.CORPUS_WORD)).alias("words"))
    return grammar.boolean_search(rows, 'license "version 2.0" NOT the OR mit releas*').select("doc_id")


@query("SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)?'), lambda w: starts_with(w, 'licen'))) > 0")
def prefix_terms(spark, t):
    rows = t("documents").select("doc_id", "text", F.array_distinct(tx.words(F.lower("text"), tx.CORPUS_WORD)).alias("words"))
    return grammar.boolean_search(rows, "licen*").select("doc_id")


@query("WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}]+)?')) AS w FROM documents) SELECT doc_id FROM p WHERE w = 'license' INTERSECT (SELECT doc_id FROM p WHERE w = 'mit' UNION SELECT doc_id FROM p WHERE w = 'apache')")
def candidate_sets(spark, t):
    postings = t("documents").select("doc_id", F.explode(F.array_distinct(tx.words(F.lower("text"), tx.CORPUS_WORD))).alias("term"))
    return grammar.candidate_rows(grammar.parse_boolean("license (mit OR apache) NOT zzz"), postings, t("documents"), "doc_id")


def near_sql(left: str, right: str, on: str) -> str:
    return f"WITH {SENTENCE_TOKENS} SELECT a.doc_id AS doc, a.para::INT AS para, least(a.pos, b.pos)::BIGINT AS first, greatest(a.pos, b.pos)::BIGINT AS last FROM ft a JOIN ft b ON a.doc_id = b.doc_id AND a.para = b.para AND {on} WHERE a.term = '{left}' AND b.term = '{right}'"


def _near(t, asked: str):
    tree = grammar.parse_proximity(asked)
    found = grammar.search(tree, line_tokens(t, tree))
    return found.select("doc", "para", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(near_sql("licens", "version", "true"))
def near_paragraph(spark, t):
    return _near(t, "license /p version")


@query(near_sql("licens", "version", "greatest(b.pos - a.pos, a.pos - b.pos) <= 3"))
def near_words(spark, t):
    return _near(t, "license /3 version")


@query(near_sql("licens", "version", "a.sent = b.sent"))
def near_sentence(spark, t):
    return _near(t, "license /s version")


@query(f"WITH {SENTENCE_TOKENS} SELECT doc_id AS doc, para::INT AS para, pos::BIGINT AS first, pos::BIGINT AS last FROM ft a WHERE term = 'licens' AND NOT EXISTS (SELECT 1 FROM ft b WHERE b.doc_id = a.doc_id AND b.para = a.para AND b.term = 'version' AND abs(b.pos - a.pos) <= 3)")
def near_not(spark, t):
    return _near(t, "license /3 NOT version")


@query(f"WITH {SENTENCE_TOKENS} SELECT doc_id AS doc, para::INT AS para, pos::BIGINT AS first, pos::BIGINT AS last FROM ft WHERE term = 'licens' AND doc_id NOT IN (SELECT doc_id FROM ft WHERE term = 'mit')")
def doc_level_not(spark, t):
    return _near(t, "license NOT mit")


@query(f"WITH {SENTENCE_TOKENS}, h AS (SELECT doc_id AS doc, para, pos AS s, pos + 3 AS e FROM ft WHERE term IN ('the', 'of')), m AS (SELECT *, max(e) OVER (PARTITION BY doc, para ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM h), i AS (SELECT *, sum((far IS NULL OR s > far)::INT) OVER (PARTITION BY doc, para ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT doc, para::INT AS para, min(s)::BIGINT AS \"start\", max(e)::BIGINT AS \"end\", count(*)::BIGINT AS parts FROM i GROUP BY doc, para, g")
def merge_hits(spark, t):
    hits = search.only(line_tokens(t, grammar.parse_proximity("the OR of")), ["the", "of"]).select("doc", "para", F.col("pos").cast("long").alias("start"), (F.col("pos") + 3).cast("long").alias("end"))
    return passages.merged(hits, "doc", "para")


@query(f"WITH {TOKENS}, h AS (SELECT doc_id, pos, term FROM ft WHERE term IN ({_LIST})), d AS (SELECT doc_id, pos, len(list_distinct(list(term) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 9 PRECEDING AND 37 FOLLOWING))) AS n FROM h) SELECT doc_id, arg_min(pos, (-n, pos))::INT AS anchor, max(n)::INT AS \"distinct\" FROM d GROUP BY doc_id")
def densest_window(spark, t):
    hits = search.only(doc_tokens(t), TERMS)
    return passages.densest(hits, "doc_id", at="pos", lead=9, width=46)


@query("SELECT doc_id, substr(text, greatest(0, strpos(text, 'icense') - 91) + 1, 460) AS excerpt FROM documents WHERE strpos(text, 'icense') > 0")
def excerpts(spark, t):
    at = F.instr("text", "icense")
    return t("documents").where(at > 0).select("doc_id", passages.excerpt(F.col("text"), at - 1).alias("excerpt"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents), i AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(1, ceil((len(ws) - 120) / 96.0)::INT + 1) - 1)) AS i FROM w WHERE len(ws) > 0) SELECT doc_id, (i * 96)::INT AS \"start\", len(ws[i * 96 + 1:i * 96 + 120])::INT AS size, ws[i * 96 + 1] AS first FROM i")
def windows_120_96(spark, t):
    rows = t("documents").select("doc_id", F.explode(passages.word_windows(tx.words(F.col("text")))).alias("w"))
    return rows.select("doc_id", F.col("w.start").alias("start"), F.size("w.words").alias("size"), F.element_at("w.words", 1).alias("first"))


@query()
def segment_passages(spark, t):
    rows = t("documents").select("doc_id", F.posexplode(passages.passages("text")).alias("n", "p"))
    return rows.select("doc_id", "n", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.xxhash64("p.text").alias("hash"))


_PIECES = r"[^ \t\r\n\x{A0}]+"


@query(rf"""WITH RECURSIVE ln AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS n, w, greatest(0, ceil((w - {passages.MOST}) / {passages.CHUNK}.0))::INT AS k FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS para, len(regexp_extract_all(line, '{_PIECES}')) AS w FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE w > 0),
f(doc_id, n, k, p, size, growing) AS (SELECT doc_id, n, k, k + 1, w - {passages.CHUNK} * k, k = 0 AND w < {passages.LEAST} FROM ln WHERE n = 1
 UNION ALL SELECT l.doc_id, l.n, l.k, CASE WHEN growing AND l.k = 0 AND size + w <= {passages.MOST} THEN p ELSE p + l.k + 1 END, CASE WHEN growing AND l.k = 0 AND size + w <= {passages.MOST} THEN size + w ELSE w - {passages.CHUNK} * l.k END,
  l.k = 0 AND CASE WHEN growing AND size + w <= {passages.MOST} THEN size + w ELSE w END < {passages.LEAST} FROM f JOIN ln l ON l.doc_id = f.doc_id AND l.n = f.n + 1),
s AS (SELECT doc_id, p, max(size) AS size, arg_max(growing, n) AS growing FROM f GROUP BY doc_id, p UNION ALL SELECT doc_id, unnest(generate_series(p - k, p - 1)), {passages.CHUNK}, false FROM f WHERE k > 0),
e AS (SELECT *, p = max(p) OVER (PARTITION BY doc_id) AND growing AND size < {passages.TAIL} AND lag(size) OVER (PARTITION BY doc_id ORDER BY p) + size <= {passages.MOST} AS joins FROM s)
SELECT doc_id, (p - 1)::INT AS n, (size + coalesce(lead(CASE WHEN joins THEN size END) OVER (PARTITION BY doc_id ORDER BY p), 0))::INT AS words FROM e QUALIFY NOT coalesce(joins, false)""")
def passage_sizes(spark, t):
    rows = t("documents").select("doc_id", F.posexplode(passages.passages("text")).alias("n", "p"))
    return rows.select("doc_id", "n", F.size(tx.words(F.col("p.text"), _PIECES)).alias("words"))


@query()
def character_windows(spark, t):
    rows = t("documents").select("doc_id", F.posexplode(passages.character_windows("text")).alias("n", "p"))
    return rows.select("doc_id", "n", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


@query(r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
o AS (SELECT doc_id, n, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS s, NOT regexp_matches(line, '\S') AS blank, regexp_matches(line, '^\s*(?:\[\d+\]|\d+[.)](?:\s|$))') AS item, regexp_extract(line, '^\s*(\d+(?:\.\d+)*)\.(\d+)[.)]?(?:\s|$)', 1) AS under, try_cast(regexp_extract(line, '^\s*(\d+(?:\.\d+)*)\.(\d+)[.)]?(?:\s|$)', 2) AS HUGEINT) AS number FROM l),
c AS (SELECT doc_id, n, lag(number) OVER w + 1 = number OR lead(number) OVER w = number + 1 AS section FROM o WHERE under <> '' AND NOT item WINDOW w AS (PARTITION BY doc_id, under ORDER BY n)),
b AS (SELECT o.*, NOT blank AND (item OR coalesce(section, false) OR coalesce(lag(blank) OVER (PARTITION BY o.doc_id ORDER BY o.n), true)) AS opens FROM o LEFT JOIN c USING (doc_id, n)),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM b)
SELECT doc_id, count(*)::BIGINT AS paragraphs, sum(chars)::BIGINT AS chars FROM (SELECT doc_id, p, max(s + length(line)) - min(s) AS chars FROM g WHERE NOT blank GROUP BY doc_id, p) GROUP BY doc_id""")
def paragraph_spans(spark, t):
    rows = t("documents").select("doc_id", F.explode(passages.paragraphs("text")).alias("p"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.col("p.end") - F.col("p.start")).alias("chars"))


_SHORT = "|".join(passages.ABBREVIATIONS.split())


@query(rf"""WITH {LINES}, raw AS (SELECT doc_id, para, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n FROM (SELECT doc_id, para, string_split(regexp_replace(line, '([.!?]["''’”)]{{0,3}})\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM ln)),
f AS (SELECT *, lag(piece) OVER w AS before FROM raw WINDOW w AS (PARTITION BY doc_id, para ORDER BY n)),
g AS (SELECT *, sum((before IS NOT NULL AND NOT regexp_matches(before, '(?:^|[^\p{{L}}\p{{N}}])(?i:{_SHORT})\.$') AND NOT regexp_matches(piece, '^\p{{Ll}}') AND NOT (regexp_matches(before, '(?:^|[^\p{{L}}\p{{N}}])[A-Z]\.[A-Z]\.$') AND regexp_matches(piece, '^[0-9]')))::INT) OVER (PARTITION BY doc_id, para ORDER BY n) AS s FROM f),
u AS (SELECT doc_id, para, s, trim(string_agg(piece, ' ' ORDER BY n)) AS unit, sum(length(trim(piece))) AS solid FROM g GROUP BY ALL),
c AS (SELECT doc_id, para, len(list_filter(CASE WHEN length(unit) <= {passages.LONGEST} THEN [unit] ELSE regexp_extract_all(unit, '(?s).{{1,600}}.{{0,600}}$|.{{600}}.{{1,600}} |.{{1,600}}.{{0,600}}') END, lambda x: trim(x) <> '')) AS n FROM u)
SELECT doc_id, para::INT AS para, sum(n)::INT AS sentences FROM c GROUP BY doc_id, para""")
def sentence_units(spark, t):
    lines = passages.lines(t("documents"), "doc_id")
    return lines.select("doc_id", "para", F.size(passages.sentences(F.col("line"))).alias("sentences"))


@query(rf"SELECT doc_id::BIGINT AS doc_id, n::INT AS n, ' ' || array_to_string(regexp_extract_all(lower(translate(text, '{tx.ACCENTED}', '{tx.PLAIN}')), '[\p{{L}}\p{{N}}\p{{M}}]+'), ' ') || ' ' LIKE '% apache license %' AS found FROM (SELECT doc_id, n_chars AS n, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200) WHERE ' ' || array_to_string(regexp_extract_all(lower(translate(text, '{tx.ACCENTED}', '{tx.PLAIN}')), '[\p{{L}}\p{{N}}\p{{M}}]+'), ' ') || ' ' LIKE '% apache license %' ORDER BY n DESC, doc_id LIMIT 5")
def phrases_in_order(spark, t):
    """Of the 200 best candidates, here the longest texts, the first five that hold the phrase."""
    best = t("documents").select(F.col("doc_id").alias("pid"), F.col("n_chars").cast("double").alias("score"))
    texts = t("documents").select(F.col("doc_id").alias("pid"), "text")
    found = search.verified_phrases(best, texts, ["Apache License"], 5, 200)
    return found.select(F.col("pid").alias("doc_id"), F.col("score").cast("int").alias("n"), F.lit(True).alias("found"))


@query(near_sql("licens", "version", "true").split("SELECT a.doc_id")[0] + " SELECT doc_id AS doc, para::INT AS para, pos::BIGINT AS first, pos::BIGINT AS last FROM ft WHERE term IN ('licens', 'mit')")
def near_or(spark, t):
    return _near(t, "licenses OR mit")


@query(near_sql("licens", "version", "true").split("SELECT a.doc_id")[0] + " SELECT a.doc_id AS doc, a.para::INT AS para, least(a.pos, b.pos, c.pos)::BIGINT AS first, greatest(a.pos, b.pos, c.pos)::BIGINT AS last FROM ft a JOIN ft b ON a.doc_id = b.doc_id AND a.para = b.para JOIN ft c ON c.doc_id = b.doc_id AND c.para = b.para AND abs(c.pos - b.pos) <= 3 WHERE a.term = 'apach' AND b.term = 'licens' AND c.term = 'version'")
def near_mixed(spark, t):
    """/3 binds tighter than /p."""
    return _near(t, "apache /p license /3 version")


@query(f"WITH {LINES}, n AS (SELECT doc_id, para, sum(len) OVER (PARTITION BY doc_id ORDER BY para) - len AS first FROM (SELECT doc_id, para, length(line) + 1 AS len FROM ln)), p AS (SELECT doc_id, n_chars * k // 4 AS at FROM documents, (VALUES (1), (2), (3)) v(k)) SELECT p.doc_id, p.at, max(n.first)::BIGINT AS first FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND n.first <= p.at GROUP BY p.doc_id, p.at")
def range_join_pid_doc(spark, t):
    lines = passages.lines(t("documents"), "doc_id").select("doc_id", "para", (F.length("line") + 1).cast("long").alias("len"))
    order = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    ranges = lines.withColumn("first", F.sum("len").over(order) - F.col("len")).select("doc_id", "first")
    points = t("documents").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.floor(F.col("n_chars") * k / 4))).alias("at")).distinct()
    return passages.containing(points, ranges, "at", "first", "doc_id")


@query(f"WITH {TOKENS}, {bm25_sql('ft', 'doc_id', 10).replace('SELECT doc_id, round', ', best AS (SELECT doc_id, round', 1)}) SELECT doc_id, score, source, left(text, 40) AS head FROM best JOIN documents USING (doc_id)")
def late_materialise(spark, t):
    best = search.ranked_scan(t("documents"), ASKED, 10, "doc_id")
    return search.materialised(best, t("documents"), "doc_id", 10, F.desc("score"), F.asc("doc_id")).select("doc_id", "score", "source", F.substring("text", 1, 40).alias("head"))


@query(f"WITH {TOKENS}, {bm25_sql('ft', 'doc_id', 30).replace('SELECT doc_id, round', ', best AS (SELECT doc_id, round', 1)}) SELECT doc_id, score FROM best WHERE doc_id NOT IN (SELECT doc_id FROM best ORDER BY score DESC, doc_id LIMIT 5) ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def seen_exclusion_page(spark, t):
    best = search.ranked_scan(t("documents"), ASKED, 30, "doc_id")
    rest = search.unseen(best, search.top(best, 5, "doc_id"), "doc_id")
    return search.page(rest, 10, 10, F.desc("score"), F.asc("doc_id"))


def _vectors(t):
    asked = t("embeddings").where(F.col("vec_id").isin(0, 7, 11)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return nearest.search(t("embeddings"), asked, 10)


NEAREST = "s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id IN (0, 7, 11)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"


@query(f"WITH {NEAREST} SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= 10")
def vector_cosine_topk(spark, t):
    return _vectors(t)


@query("""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings), z AS (SELECT vec_id, list_transform(e, lambda x: round(x / l * 127)::DOUBLE) AS q FROM u),
i AS (SELECT vec_id, q, (1 / sqrt(list_dot_product(q, q)))::FLOAT::DOUBLE AS inv FROM z), a AS (SELECT list_transform(e, lambda x: x / l) AS e FROM u WHERE vec_id = 0)
SELECT vec_id, round(list_dot_product(a.e, i.q) * inv, 4) AS score FROM i, a ORDER BY score DESC, vec_id LIMIT 20""")
def vector_int8_topk(spark, t):
    asked = t("embeddings").where("vec_id = 0").first()["embedding"]
    return search.top(nearest.quantised_scores(t("embeddings"), list(asked), digits=4), 20, "vec_id")


@query(f"WITH {NEAREST}, v AS (SELECT query_id, label, count(*) AS votes FROM r JOIN embeddings USING (vec_id) WHERE rank <= 10 GROUP BY ALL) SELECT query_id, arg_min(label, (-votes, label)) AS winner, max(votes)::BIGINT AS votes FROM v GROUP BY query_id")
def knn_label_vote(spark, t):
    return nearest.vote(_vectors(t), t("embeddings"))


@query(f"""WITH {TOKENS}, {bm25_sql('ft', 'doc_id', 50).replace('SELECT doc_id, round', ', best AS (SELECT doc_id, round', 1)}),
run AS (SELECT 1 AS query, doc_id AS doc, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM best), gold AS (SELECT 'apache' AS "set", 1 AS query, doc_id AS doc FROM documents WHERE contains(text, 'Apache License') UNION ALL SELECT 'none', 2, 1),
f AS (SELECT query, min(rank) AS rank FROM gold JOIN run USING (query, doc) WHERE rank <= 20 GROUP BY query)
SELECT "set", count(*)::BIGINT AS queries, round(avg((rank IS NOT NULL)::INT::DOUBLE), 3) AS recall, round(avg(coalesce(1 / rank, 0)), 3) AS mrr FROM (SELECT DISTINCT "set", query FROM gold) LEFT JOIN f USING (query) GROUP BY "set" """)
def retrieval_metrics(spark, t):
    best = search.ranked_scan(t("documents"), ASKED, 50, "doc_id")
    run = best.select(F.lit(1).alias("query"), F.col("doc_id").alias("doc"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")).alias("rank"))
    gold = t("documents").where(F.contains("text", F.lit("Apache License"))).select(F.lit("apache").alias("set"), F.lit(1).alias("query"), F.col("doc_id").alias("doc"))
    gold = gold.unionByName(spark.createDataFrame([("none", 2, 1)], "`set` string, query int, doc long"))
    return metrics.retrieval(run, gold)


@query()
def index_terms_porter(spark, t):
    tokens = tx.exploded(t("documents"), "doc_id", pattern=tx.INDEX_WORD).groupBy(F.lower(tx.unaccent(F.col("word"))).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return tokens.withColumn("term", tx.index_terms("token")).where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
