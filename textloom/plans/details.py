"""Queries on the smaller operators: titles, tails, marks, audits, filters of views, anchors, merges of keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, locators
from ..functions import text as tx
from ..operators import events, metrics, nearest, passages, resolve, search
from ..sources import writers
from ..streaming import incremental
from .catalog import query
from .retrieval import LINES, LOUD, TERMS, TOKENS, WORD, doc_tokens

TITLE_WORDS = f"tt AS (SELECT DISTINCT p_partkey AS doc, unnest(regexp_extract_all(lower(p_name), '{WORD}')) AS term FROM part)"


def _title_terms(t):
    return t("part").select(F.col("p_partkey").alias("doc"), F.explode(tx.words(F.lower("p_name"))).alias("term")).distinct()


@query(f"WITH {TITLE_WORDS}, n AS (SELECT count(DISTINCT doc) AS n FROM tt), w AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tt, n WHERE term IN ('part', '7', '12') GROUP BY term, n) SELECT doc, round(sum(idf), 6) AS title_score FROM tt JOIN w USING (term) GROUP BY doc")
def title_scores(spark, t):
    return search.title_scores(_title_terms(t), ["part", "7", "12"]).select("doc", F.round("title_score", 6).alias("title_score"))


@query("WITH h AS (SELECT o_custkey AS doc, o_orderkey AS pid, o_totalprice AS score FROM orders), hit AS (SELECT DISTINCT doc FROM h WHERE score > 400000), ti AS (SELECT c_custkey AS doc, c_acctbal AS title_score FROM customer), alone AS (SELECT doc FROM ti WHERE doc NOT IN (SELECT doc FROM hit) ORDER BY title_score DESC, doc LIMIT 20) SELECT doc, arg_max(pid, (score, -pid)) AS pid, max(score) AS score FROM h WHERE doc IN (SELECT doc FROM alone) GROUP BY doc")
def title_only_documents(spark, t):
    scored = t("orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("pid"), F.col("o_totalprice").alias("score"))
    titled = t("customer").select(F.col("c_custkey").alias("doc"), F.col("c_acctbal").alias("title_score"))
    return search.title_only(titled, scored.where("score > 400000"), scored)


@query(f"WITH {TOKENS} SELECT doc_id AS doc, round(b + 15 * (0.5 * coalesce(ts, 0) + log10(1 + coalesce(c, 0))), 6) AS score FROM (SELECT doc_id, count(*)::DOUBLE AS b FROM ft WHERE term = 'the' GROUP BY doc_id) LEFT JOIN (SELECT doc_id, 1.5 AS ts FROM documents WHERE doc_id % 3 = 0) USING (doc_id) LEFT JOIN (SELECT doc_id, doc_id % 5 AS c FROM documents) USING (doc_id)")
def weighted_documents(spark, t):
    hits = search.only(doc_tokens(t), ["the"]).groupBy(F.col("doc_id").alias("doc")).agg(F.count(F.lit(1)).cast("double").alias("score")).withColumn("pid", F.col("doc"))
    titles = t("documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"), F.lit(1.5).alias("title_score"))
    cited = t("documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 5).alias("cited_by"))
    return search.documents(hits, cited, titles, title_weight=0.5).select("doc", "score")


@query("SELECT doc_id FROM documents WHERE (doc_id < 600 AND contains(text, 'License')) OR doc_id >= 600")
def residual_tail(spark, t):
    docs = t("documents").select("doc_id", "text")
    return search.with_tail(docs, docs.where(F.contains("text", F.lit("License"))), 600, "doc_id", "doc_id").select("doc_id")


_LOUD = ", ".join(f"'{x}'" for x in LOUD)
_ALL = ", ".join(f"'{x}'" for x in TERMS)


@query(f"WITH {TOKENS}, h AS (SELECT doc_id, pos, term, term IN ({_LOUD}) AS l FROM ft WHERE term IN ({_ALL})), m AS (SELECT *, bool_or(l) OVER (PARTITION BY doc_id) AS a FROM h) SELECT doc_id, pos::INT AS pos, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM m WHERE l = a) WHERE n <= 100")
def marked_words(spark, t):
    hits = search.only(doc_tokens(t), TERMS).select("doc_id", "pos", "term")
    return search.marked_hits(hits, "doc_id", LOUD)


@query(r"SELECT doc_id, CASE WHEN length(text) > s + 600 THEN regexp_replace(body, '\s+\S*\z', '') ELSE body END AS snippet FROM (SELECT doc_id, text, s, CASE WHEN s > 0 THEN regexp_replace(substr(text, s + 1, 600), '^\S*\s+', '') ELSE substr(text, s + 1, 600) END AS body FROM (SELECT doc_id, text, greatest(0, strpos(text, 'icense') - 201) AS s FROM documents WHERE strpos(text, 'icense') > 0))")
def snippets(spark, t):
    at = F.instr("text", "icense")
    return t("documents").where(at > 0).select("doc_id", search.snippet(F.col("text"), at - 1).alias("snippet"))


@query("SELECT source, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS share FROM documents GROUP BY source")
def dataset_stats(spark, t):
    docs = t("documents")
    total = docs.agg(F.sum("n_chars").alias("all"))
    out = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    return out.join(F.broadcast(total)).select("source", "docs", "chars", F.round(F.col("chars") / F.col("all"), 6).alias("share"))


SCOPED = TOKENS.replace("FROM documents", "FROM documents WHERE source IN ('src1', 'src2')")


@query(f"WITH {SCOPED} SELECT count(DISTINCT doc_id)::BIGINT AS units, count(*)::BIGINT AS length, count(DISTINCT CASE WHEN term = 'the' THEN doc_id END)::BIGINT AS df FROM ft")
def scope_statistics(spark, t):
    scoped = t("documents").where(F.col("source").isin("src1", "src2"))
    tokens = tx.with_fold(tx.exploded(scoped, "doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("term") == "the").alias("has"))
    return tokens.agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("length"), F.sum(F.col("has").cast("int")).alias("df"))


@query("SELECT view, count(*)::BIGINT AS n FROM (SELECT unnest([CASE WHEN live THEN 'all' END, CASE WHEN live AND likely THEN 'likely' END, CASE WHEN live AND likely AND dated AND NOT unsure THEN 'focus' END, CASE WHEN live AND NOT dated THEN 'undated' END, CASE WHEN live AND unsure THEN 'review' END, CASE WHEN NOT live THEN 'excluded' END]) AS view FROM (SELECT event_id % 11 > 0 AS live, event_id % 7 > 0 AS dated, event_id % 5 = 0 AS unsure, coalesce(CASE WHEN event_id % 3 > 0 THEN value / 100 END, 1) >= 0.5 AS likely FROM events)) WHERE view IS NOT NULL GROUP BY view")
def event_views(spark, t):
    rows = t("events").select(F.when(F.col("event_id") % 3 > 0, F.col("value") / 100).alias("rank"), F.when(F.col("event_id") % 7 > 0, "2024-01-01").alias("date"), (F.col("event_id") % 5 == 0).alias("uncertain"), (F.col("event_id") % 11 == 0).alias("excluded"))
    names = ("all", "likely", "focus", "undated", "review", "excluded")
    shown = rows.select(F.explode(F.filter(F.array(*[F.when(events.in_view(v), v) for v in names]), lambda x: x.isNotNull())).alias("view"))
    return shown.groupBy("view").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, 10 AS d_start, CASE WHEN o_orderkey % 3 = 1 THEN 32 ELSE 34 END AS d_end, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') AS date_end FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 > 0")
def date_ranges(spark, t):
    """Two dates with `to`, a dash or other words between them; every fifth order says them the wrong way round."""
    day, later = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 9), "yyyy-MM-dd")
    between = F.element_at(F.array(F.lit(" or "), F.lit(" – ").substr(2, 2), F.lit(" to ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    back = F.col("o_orderkey") % 5 == 0
    said = F.concat(F.lit("Closed on "), F.when(back, later).otherwise(day), between, F.when(back, day).otherwise(later), F.lit(", and 2031-03-01."))
    rows = t("orders").select(F.col("o_orderkey").alias("id"), said.alias("text"))
    found = rows.select("id", "text", F.explode(dates.date_candidates("text", F.lit(None).cast("string"))).alias("d"))
    return events.date_ranges(found.select("id", "text", F.col("d.start").alias("d_start"), F.col("d.end").alias("d_end"), "d.date"), "id")


@query("SELECT conv_id::BIGINT * 1048576 + turn AS id, CASE turn % 3 WHEN 0 THEN 1 ELSE 0 END AS first, CASE turn % 3 WHEN 0 THEN 3 ELSE 3 END AS last FROM conversations WHERE turn % 3 <> 1")
def correspondence_headers(spark, t):
    """Turns as letters: a full header after a greeting, scattered header lines, a French header."""
    said = F.element_at(F.array(F.lit("Hello\nFrom: "), F.lit("From: a\nText\nDate: x\nTo: b\n"), F.lit("De : a\nObjet : b\nEnvoyé : c\nÀ : ")), (F.col("turn") % 3 + 1).cast("int"))
    text = F.concat(said, F.col("role"), F.when(F.col("turn") % 3 == 0, "\nTo: b\nSent: today\n").otherwise("\n"), F.regexp_replace("text", "(?i)(from|to|cc|bcc|date|sent|subject|re|de|à|envoyé|objet)(\\s*:)", "$1"))
    rows = passages.lines(t("conversations").select((F.col("conv_id").cast("long") * (1 << 20) + F.col("turn")).alias("id"), text.alias("text")), "id")
    return events.header_lines(rows, "id")


_NUMBERED = "CASE WHEN para % 3 = 0 THEN (para + 1) || '. ' || line ELSE line END"


@query(rf"WITH {LINES}, x AS (SELECT doc_id, {_NUMBERED} AS line FROM ln), m AS (SELECT doc_id, count(*) AS long, count(*) FILTER (WHERE regexp_matches(line, '^\s*(?:\[[0-9]{{1,4}}\]|[0-9]{{1,4}}[.)])\s')) AS hit FROM x WHERE length(line) > 200 GROUP BY doc_id) SELECT doc_id FROM m WHERE hit >= 20 OR hit >= 0.3 * long")
def numbering_accepted(spark, t):
    rows = passages.lines(t("documents"), "doc_id")
    rows = rows.withColumn("line", F.when(F.col("para") % 3 == 0, F.concat((F.col("para") + 1).cast("string"), F.lit(". "), F.col("line"))).otherwise(F.col("line")))
    return passages.numbered(rows, "doc_id")


@query("SELECT doc_id, (substr(coalesce(text, ''), doc_id % 50 + 1, 40) = CASE WHEN doc_id % 3 = 0 THEN upper(substr(coalesce(text, ''), doc_id % 50 + 1, 40)) ELSE substr(coalesce(text, ''), doc_id % 50 + 1, 40) END)::INT AS intact FROM documents")
def source_integrity(spark, t):
    """Quotations of every document, every third in capitals, against their places."""
    start = (F.col("doc_id") % 50).cast("int")
    text = F.coalesce("text", F.lit(""))
    quote = F.substring(text, start + 1, F.lit(40))
    rows = t("documents").select("doc_id", text.alias("text"), start.alias("s"), (start + 40).alias("e"), F.when(F.col("doc_id") % 3 == 0, F.upper(quote)).otherwise(quote).alias("quote"))
    return rows.select("doc_id", passages.intact(F.col("text"), F.col("s"), F.col("e"), F.col("quote")).cast("int").alias("intact"))


@query("SELECT l_suppkey, l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def keep_first(spark, t):
    return resolve.first_of(t("lineitem"), "l_suppkey", "l_partkey", order=[F.col("l_orderkey"), F.col("l_linenumber")]).select("l_suppkey", "l_partkey", "l_orderkey")


@query("WITH base AS (SELECT p_name AS k, min(p_partkey) AS v FROM part WHERE p_size <= 10 GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1), more AS (SELECT p_name AS k, min(p_partkey) AS v FROM part WHERE p_size > 10 GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1) SELECT k, v, 0 AS step FROM base UNION ALL SELECT k, v, 1 FROM more WHERE k NOT IN (SELECT k FROM base)")
def routed_keys(spark, t):
    p = t("part").select(F.col("p_name").alias("k"), F.col("p_partkey").alias("id"), "p_size")
    steps = [resolve.unique(p.where(c), "k", "id") for c in ("p_size <= 10", "p_size > 10")]
    return resolve.cascade(steps, "k").withColumnRenamed("id", "v")


@query("""WITH f AS (SELECT p_name AS name, min(p_partkey) AS low, max(p_partkey) AS high FROM part WHERE p_size > 5 GROUP BY p_name),
r AS (SELECT p_type AS kind, CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 1 ELSE p_partkey END AS expected, CASE WHEN p_partkey % 20 = 0 THEN p_partkey ELSE -1 END AS later, low, high FROM part LEFT JOIN f ON f.name = p_name)
SELECT kind, count(*) FILTER (WHERE low = high AND low = expected)::BIGINT AS exact, count(*) FILTER (WHERE low = high AND low <> expected AND low = later)::BIGINT AS consolidated, count(*) FILTER (WHERE low = high AND low <> expected AND low <> later)::BIGINT AS wrong, count(*) FILTER (WHERE low < high)::BIGINT AS ambiguous, count(*) FILTER (WHERE low IS NULL)::BIGINT AS missing FROM r GROUP BY kind""")
def resolution_audit(spark, t):
    k = F.col("p_partkey")
    asked = t("part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.when(k % 10 == 0, k + 1).otherwise(k).alias("expected"), F.when(k % 20 == 0, k).otherwise(-1).alias("consolidated"))
    found = t("part").where("p_size > 5").select(F.col("p_name").alias("name"), k.alias("id"))
    return metrics.resolution_audit(asked, found, "name", "kind")


_CHECKS = {"price": "o_totalprice > 2000", "dear": "o_totalprice < 400000", "status": "o_orderstatus <> 'P'", "old": "o_orderdate < DATE '1998-06-01'", "new": "o_orderdate >= DATE '1992-03-01'", "key": "o_orderkey % 11 <> 0", "customer": "o_custkey % 13 <> 0", "said": "o_orderpriority NOT LIKE '5%'"}


@query("SELECT o_orderpriority AS family, count(*)::BIGINT AS cases, count(*) FILTER (WHERE " + " AND ".join(_CHECKS.values()) + ")::BIGINT AS passed, " + ", ".join(f"count(*) FILTER (WHERE NOT ({c}))::BIGINT AS failed_{n}" for n, c in _CHECKS.items()) + " FROM orders GROUP BY o_orderpriority")
def evaluation_receipts(spark, t):
    return metrics.receipts(t("orders").withColumnRenamed("o_orderpriority", "family").withColumn("o_orderpriority", F.col("family")), "family", {n: F.expr(c) for n, c in _CHECKS.items()})


@query("SELECT p_brand, arg_min(p_name, (-length(p_name), p_name)) AS label, min(p_size) AS year FROM part GROUP BY p_brand")
def longest_label(spark, t):
    return resolve.labelled(t("part").select("p_brand", F.col("p_name").alias("label"), F.col("p_size").alias("year")), "p_brand")


@query("WITH g AS (SELECT doc_id % 7 AS query, doc_id AS doc, 0 AS s, 40 AS e FROM documents WHERE doc_id % 3 = 0), r AS (SELECT doc_id % 7 AS query, doc_id AS doc, 30 AS s, 90 AS e, (doc_id // 7 + 1) AS rank FROM documents WHERE doc_id % 2 = 0) SELECT round(avg(h), 3) AS recall FROM (SELECT g.query, max((r.doc IS NOT NULL)::INT) AS h FROM g LEFT JOIN r ON r.query = g.query AND r.doc = g.doc AND r.rank <= 10 AND g.s < r.e AND r.s < g.e GROUP BY g.query)")
def passage_recall(spark, t):
    d = t("documents").select((F.col("doc_id") % 7).alias("query"), F.col("doc_id").alias("doc"))
    gold = d.where("doc % 3 = 0").select("query", "doc", F.lit(0).alias("start"), F.lit(40).alias("end"))
    runs = d.where("doc % 2 = 0").select("query", "doc", F.lit(30).alias("start"), F.lit(90).alias("end"), (F.floor(F.col("doc") / 7) + 1).alias("rank"))
    return metrics.passage_recall(runs, gold)


def _loose(col: str) -> str:
    """SQL of a loose title."""
    key = f"trim(regexp_replace(replace(lower(translate({col}, '{tx.ACCENTED}', '{tx.PLAIN}')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({key}, '^(?:the|la|le|les|l) ', ''), ' (?:18|19|20)[0-9]{{2}}$', ''), '\bregulations\b', 'regulation', 'g'), '\breglements\b', 'reglement', 'g')"


# Part names as titles: articles, years, plurals and signs are the part of the rule that matters.
_TITLE = "CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name || ' Regulations 1990' WHEN 1 THEN 'Les Règlements & ' || p_name WHEN 2 THEN p_name ELSE '' END"
_WANTED = "The Part Name 7 Regulation, 2004"


@query(f"SELECT p_partkey, title, (title = '' OR len(list_intersect(list_distinct(string_split({_loose('title')}, ' ')), list_distinct(string_split({_loose(chr(39) + _WANTED + chr(39))}, ' ')))) / least(len(list_distinct(string_split({_loose('title')}, ' '))), len(list_distinct(string_split({_loose(chr(39) + _WANTED + chr(39))}, ' ')))) >= 0.5)::INT AS fits FROM (SELECT p_partkey, {_TITLE} AS title FROM part)")
def similar_titles(spark, t):
    way, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(way == 0, F.concat(F.lit("The "), name, F.lit(" Regulations 1990"))).when(way == 1, F.concat(F.lit("Les Règlements & "), name)).when(way == 2, name).otherwise("")
    rows = t("part").select("p_partkey", title.alias("title"))
    return rows.select("p_partkey", "title", tx.similar_titles(F.col("title"), F.lit(_WANTED)).cast("int").alias("fits"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders GROUP BY ALL) b ON a.k = b.k")
def imported_maps(spark, t):
    ours = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.create_map(F.lit("x"), F.col("c_mktsegment")).alias("m"))
    theirs = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("p")).select("k", F.create_map(F.lit("x"), F.col("p")).alias("m"))
    return writers.imported(ours, theirs, "k", ["m"]).select("k", F.col("m")["x"].alias("v"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 6 = 0")
def merged_changes(spark, t):
    table = t("customer").select("c_custkey", "c_acctbal")
    changes = table.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), (F.col("c_custkey") % 2 == 1).alias("gone"))
    return writers.merged(table, changes, "c_custkey", "gone")


@query("""WITH RECURSIVE l AS (SELECT s_name AS name, floor(s_acctbal)::BIGINT + 2000 AS size, row_number() OVER (ORDER BY s_name) AS n FROM supplier),
g(n, name, size, grp, held) AS (SELECT n, name, size, 0::BIGINT, size FROM l WHERE n = 1 UNION ALL SELECT l.n, l.name, l.size, CASE WHEN g.held > 0 AND g.held + l.size > 20000 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.held > 0 AND g.held + l.size > 20000 THEN l.size ELSE g.held + l.size END FROM g JOIN l ON l.n = g.n + 1)
SELECT name, size, grp FROM g""")
def packed_listing(spark, t):
    sizes = t("supplier").select(F.col("s_name").alias("name"), (F.floor("s_acctbal") + 2000).alias("size"))
    return writers.packed_groups(sizes, 20000).select("name", "size", "grp")


@query("SELECT event_id, (0.5 + (event_id % 5) / 10.0) - CASE WHEN event_id % 2 = 0 THEN 0.3 ELSE 0.2 END AS margin FROM events")
def probability_margin(spark, t):
    p = F.create_map(F.lit("a"), F.lit(0.5) + (F.col("event_id") % 5) / 10.0, F.lit("b"), F.when(F.col("event_id") % 2 == 0, 0.3).otherwise(0.2), F.lit("c"), F.lit(0.1))
    return t("events").select("event_id", nearest.margin(p).alias("margin"))


@query("SELECT page_id, ':~:text=' || replace(replace(url_encode(regexp_extract(html, '<title>([A-Za-z ]+)', 1)), '-', '%2D'), '+', '%20') AS directive FROM pages")
def text_directives(spark, t):
    title = F.regexp_extract("html", "<title>([A-Za-z ]+)", 1)
    return t("pages").select("page_id", tx.text_directive(title).alias("directive"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pre ' || page_id END AS prefix, 'start here ' || page_id AS start, CASE WHEN page_id % 3 < 2 THEN 'end, of it' END AS \"end\", CASE WHEN page_id % 3 = 0 THEN 'post-it' END AS suffix FROM pages WHERE page_id % 4 > 0")
def directive_parts(spark, t):
    """Links to text of every page, written and read back; every fourth has none."""
    k = F.col("page_id").cast("string")
    start, end = F.concat(F.lit("start here "), k), F.lit("end, of it")
    way = F.col("page_id") % 3
    said = F.when(way == 0, tx.text_directive(start, end, F.concat(F.lit("pre "), k), F.lit("post-it"))).when(way == 1, tx.text_directive(start, end)).otherwise(tx.text_directive(start))
    url = F.concat(tx.clean_url(F.col("url")), F.lit("#"), F.when(F.col("page_id") % 4 > 0, said).otherwise("top"))
    return t("pages").select("page_id", tx.parse_directive(url).alias("d")).where("d IS NOT NULL").select("page_id", "d.*")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'p ' WHEN 1 THEN 'para ' WHEN 2 THEN 's ' WHEN 3 THEN 'r ' WHEN 4 THEN 'art ' ELSE '' END || p_size AS pinpoint FROM part")
def pinpoints(spark, t):
    kind = F.element_at(F.array(*map(F.lit, ("page", "paragraph", "section", "rule", "article", "annex"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t("part").select("p_partkey", locators.pinpoint(kind, F.col("p_size").cast("string")).alias("pinpoint"))


@query(f"WITH {TOKENS} SELECT doc_id, len(list_filter(list_distinct(list(term)), lambda x: x NOT IN ('the', 'of')))::INT AS quiet FROM ft GROUP BY doc_id")
def quiet_terms(spark, t):
    terms = doc_tokens(t).select("doc_id", "term").distinct().groupBy("doc_id").agg(F.collect_set("term").alias("s"))
    return terms.select("doc_id", F.size(F.array_except("s", F.array(F.lit("the"), F.lit("of")))).alias("quiet"))


@query("SELECT query, rank, doc_id FROM (SELECT lang AS query, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank, doc_id FROM documents) WHERE rank <= 5")
def result_pages(spark, t):
    best = search.per_group(t("documents").select(F.col("lang").alias("query"), "doc_id", "n_chars"), "query", 5, F.desc("n_chars"), F.asc("doc_id"))
    w = Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc_id")
    return best.select("query", F.row_number().over(w).alias("rank"), "doc_id")


@query("SELECT doc_id, n_chars, corpus FROM (SELECT doc_id, n_chars + 1 AS n_chars, 1 AS corpus FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, n_chars, 2 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en'))")
def corpora_union(spark, t):
    """Open documents, which may say more, before the corpus's own."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    return resolve.united(d.where("lang = 'en'").select("doc_id", (F.col("n_chars") + 1).alias("n_chars")), d.select("doc_id", "n_chars"), "doc_id")


@query("SELECT page_id, 'https://site.example/en/' || left(host, 2) || '/laws/stat/' || page_id || '/latest/' || page_id || '.html' AS url FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?]*)', 1) AS host FROM pages)")
def instrument_urls(spark, t):
    host = F.regexp_extract("url", "^[a-z]+://([^/?]*)", 1)
    return t("pages").select("page_id", tx.instrument_url("https://site.example/", F.lit("English"), host, F.lit("stat"), F.col("page_id").cast("string")).alias("url"))


CLEAN_URL = r"SELECT page_id, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) || substr(u, length(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*')) + 1) AS url FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '([?&])(?:utm_[a-z]+|fbclid|gclid)=[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '[?&]+$', ''), '\?&', '?', 'g'), '/(?:index\.html?)?$', '') AS u FROM pages)"


@query(rf"WITH c AS ({CLEAN_URL}) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cite:2016scc' || page_id ELSE 'site:' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://(?:www\.)?', ''), '/(?:en|fr)(/)', '\1', 'g'), '/(?:latest|current)(/|$)', '\1', 'g') END AS key FROM c")
def identity_keys(spark, t):
    cite = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("2016 SCC "), F.col("page_id").cast("string")))
    return t("pages").select("page_id", tx.identity_key(cite, F.col("url")).alias("key"))


@query("SELECT user_id, max(ts) <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 6 HOUR AS stale FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY")
def fresh_state(spark, t):
    state = t("events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("read_at"))
    return incremental.fresh(state, "read_at", F.lit("2024-01-30 00:00:00").cast("timestamp"), "6 hours", "1 day").select("user_id", "stale")


@query("SELECT c_custkey AS tab, c_nationkey AS doc, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE (SELECT min(x.c_custkey) FROM customer x WHERE x.c_custkey % 2 = 0 AND x.c_nationkey = customer.c_nationkey) END AS now FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0)")
def moved_handles(spark, t):
    c = t("customer").select(F.col("c_custkey").alias("tab"), F.col("c_nationkey").alias("doc"))
    return incremental.moved(c, c.where("tab % 2 = 0"))


@query(f"WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents), i AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(1, ceil((len(ws) - 100) / 75.0)::INT + 1) - 1)) AS i FROM w WHERE len(ws) > 0), s AS (SELECT doc_id, len(list_filter(ws[i * 75 + 1:i * 75 + 100], lambda x: x = 'license' OR x = 'License'))::DOUBLE AS score FROM i) SELECT doc_id, max(score) AS score, count(*)::BIGINT AS windows FROM s GROUP BY doc_id")
def window_maximum(spark, t):
    """The best window of each text, by a score that any model may give; here the count of one word."""
    cut = t("documents").select("doc_id", F.explode(passages.budget_windows(tx.words(F.col("text")), 100)).alias("w"))
    scored = cut.select("doc_id", F.size(F.filter("w.words", lambda x: x.isin("license", "License"))).cast("double").alias("score"))
    return nearest.window_maximum(scored, "doc_id")


@query("SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS place FROM (SELECT doc_id, round(sqrt(n_chars), 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50)")
def rerank_order(spark, t):
    ranked = nearest.reranked(t("documents").select("doc_id", F.round(F.sqrt("n_chars"), 6).alias("score")), "doc_id").limit(50)
    return search.places(ranked, F.desc("score"), F.asc("doc_id")).withColumn("place", F.col("place").cast("int"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 20")
def dense_candidates(spark, t):
    units = t("documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    return nearest.dense_first(units, "source", "score", "doc_id", 20).select("doc_id", "source")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'drop' WHEN b.k IS NULL THEN 'add' WHEN a.f = b.f THEN 'keep' ELSE 'rebuild' END AS action FROM (SELECT o_custkey AS k, max(o_orderkey)::VARCHAR AS f FROM orders GROUP BY o_custkey) a FULL JOIN (SELECT o_custkey AS k, max(o_orderkey)::VARCHAR AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL SELECT -p_partkey - 1, 'x' FROM part) b ON a.k = b.k")
def index_actions(spark, t):
    """What an index over customers' orders must do, known from fingerprints alone."""
    mark = F.max("o_orderkey").cast("string").alias("f")
    files = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(mark)
    index = t("orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(mark)
    index = index.unionByName(t("part").select((-F.col("p_partkey") - 1).alias("k"), F.lit("x").alias("f")))
    return incremental.outdated(files, index, "k", "f")


@query("SELECT event_id, event_type, user_id, length(event_type) + user_id % 7 AS judgment FROM events")
def memoised_judgments(spark, t):
    """Judgments of all events, half of whose kinds a memo knows already."""
    judge = lambda rows: rows.withColumn("judgment", F.length("event_type") + F.col("user_id") % 7)
    rows = t("events").select("event_id", "event_type", "user_id")
    _, memo = incremental.memoised(rows.where("user_id % 2 = 0"), None, judge, "event_type", "user_id")
    return incremental.memoised(rows, memo, judge, "event_type", "user_id")[0].select("event_id", "event_type", "user_id", "judgment")
