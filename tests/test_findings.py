"""Cases that once failed on odd inputs or at size."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import events, index, passages
from textloom.plans.catalog import load
from textloom.streaming import incremental

QUERIES, _ = load()


def test_latest_order_of_a_leap_day(spark, tmp_path):
    at = lambda *d: datetime.datetime(*d)
    spark.createDataFrame([(1, 7, at(2024, 1, 5)), (2, 8, at(2024, 1, 5)), (3, None, at(2024, 1, 5))], "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    orders = [(7, at(1996, 2, 29)), (7, at(1995, 3, 1)), (8, at(1996, 2, 28)), (8, at(1999, 1, 1)), (None, at(1996, 1, 1))]
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r.event_id: r.day for r in QUERIES["asof_latest_order"](spark, str(tmp_path)).collect()}
    assert found == {1: datetime.date(1996, 2, 29), 2: datetime.date(1996, 2, 28), 3: None}


def test_ranges_without_a_start_hold_no_point(spark):
    points = spark.createDataFrame([("a", 3), ("a", None), ("b", 1)], "k string, at int")
    ranges = spark.createDataFrame([("a", None, "x"), ("a", 2, "p"), ("a", 2, "q"), ("b", 2, "y")], "k string, first int, name string")
    found = passages.containing(points, ranges, "at", "first", "k", carry=("name",)).collect()
    assert sorted((r.k, r.at or 0, r.first, r.name) for r in found) == [("a", 0, None, None), ("a", 3, 2, "q"), ("b", 1, None, None)]


def test_screens_read_patterns_as_sql_does(spark):
    cases = {
        "Appeler éonê sans attendre à paul@example.com pour la suite du dossier.": "",  # a word ends before an accent
        "Appeler eone sans attendre à paul@example.com pour la suite du dossier.": "contact details",
        "Ce message est pour le DESTINATAIRE VISÉ et pour personne d'autre ici.": "disclaimer",
        "Confirmed at last.\r": "heading or label",  # a text ends where it ends
        "\u00a0The tribunal heard it.\u00a0": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", events.screen(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]
    assert [r.line for r in passages.lines(spark.createDataFrame([("\u00a0\n \nx",)], "text string")).collect()] == ["x"]


def test_moved_handles_make_no_pairs(spark):
    rows = spark.range(200000).select(F.col("id").alias("tab"), F.lit(1).alias("doc"))
    found = incremental.moved(rows, rows.where("tab % 2 = 0 AND tab > 2"))
    assert found.agg(F.count("now"), F.sum((F.col("now") == F.col("tab")).cast("int")), F.min("now")).first() == (200000, 99998, 4)
    some = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (None, "a")], "tab int, doc string")
    held = spark.createDataFrame([(2, "a"), (5, "a"), (3, "c"), (4, None)], "tab int, doc string")
    assert sorted((r.tab or 0, r.doc, r.now) for r in incremental.moved(some, held).collect()) == [(0, "a", 2), (1, "a", 2), (2, "a", 2)]


@pytest.mark.parametrize("one_date, agree", [(False, False), (True, False), (False, True), (True, True)])
def test_blocks_of_mentions_make_every_pair(spark, monkeypatch, one_date, agree):
    """Against a plain loop, with blocks of three and terms common, rare and missing; no pair is shuffled."""
    monkeypatch.setattr(events, "BLOCK", 3)
    monkeypatch.setattr(events, "STEP", 4)
    texts = [f"common word{i % 3} word{i % 5} rare{i // 7} {i % 4 if i % 2 else ''}" for i in range(25)] + ["the", None, "", "same same", "Same  same"]
    rows = [(i, x, ["2024-01-01", "2024-01-02", "", None][i * 7 % 4]) for i, x in enumerate(texts)]
    mentions = spark.createDataFrame(rows, "id long, text string, date string")
    facts = mentions.select("id", F.lower(events.clean(F.coalesce("text", F.lit("")))).alias("body"), F.coalesce("date", F.lit("")).alias("date"), events.event_terms(F.coalesce("text", F.lit(""))).alias("terms"), events.numeric_signature(F.coalesce("text", F.lit(""))).alias("numbers"))
    first = {}
    for r in facts.orderBy("id").collect():
        first.setdefault((r.body, r.date), r)
    want = {}
    for x, y in itertools.combinations(sorted(first.values()), 2):
        shared = len(set(x.terms) & set(y.terms))
        dated = x.date == y.date != ""
        overlap = shared + 2 * dated + 1000 * (x.body == y.body)
        clash = (x.date != y.date and x.date and y.date) or (x.numbers != y.numbers and x.numbers and y.numbers)
        if overlap >= 2 and (dated or not one_date) and not (agree and clash):
            want[x.id, y.id] = (overlap, shared / max(1, min(len(x.terms), len(y.terms))))
    found = events.blocked_pairs(mentions, "share", one_date=one_date, agree=agree)
    rows = found.collect()
    assert len(rows) == len(want) and {(r.a, r.b): (r.overlap, r.share) for r in rows} == want
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_clusters_look_only_at_like_groups(monkeypatch):
    looked, shares = [], events._Event.shares
    monkeypatch.setattr(events._Event, "shares", lambda self, *a: looked.append(1) or shares(self, *a))
    mentions = [(str(i), f"common alpha{i} beta{i} gamma{i} delta{i}", "2024-01-01") for i in range(800)]
    assert events.cluster([*mentions, ("x", mentions[5][1] + " more", "2024-01-01")]) == [*range(800), 5] and len(looked) == 1
    # Without a date only equal texts meet; the greater share wins over the older group.
    assert events.cluster([("1", "one two three", ""), ("2", "one two three four", ""), ("3", "One  two three", "")]) == [0, 1, 0]
    day = "2024-01-01"
    assert events.cluster([("1", "alpha beta gamma delta", day), ("2", "alpha beta omega sigma zeta", day), ("3", "alpha beta omega", day)]) == [0, 1, 1]


def test_stored_index_is_made_without_shuffling_postings_twice(spark, tmp_path, monkeypatch):
    """The tables are those of the other way to build, with repeated and null ids and long and missing texts; each
    posting goes through one shuffle, a portion of the terms at a time, and no table of the way there is left."""
    monkeypatch.setattr(index, "BLOCK", 4)
    rows = [(i % 37, " ".join(f"w{j} same" for j in range(i % 11))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, "same lost"), (50, None), (51, ""), (52, "many " * 70000)], "doc_id long, text string")
    tokens = lambda d: tx.with_fold(tx.exploded(d, "doc_id"))
    index.write(index.build(tokens(docs), "doc_id"), f"{tmp_path}/a", 4)
    made, write = [], index.written
    monkeypatch.setattr(index, "written", lambda df: made.append((df, write(df))) or made[-1][1])
    index.write(index.build_dealt(tokens(docs.repartition(3, "doc_id")), "doc_id"), f"{tmp_path}/b", 6)
    for name in ("postings", "passages", "dictionary", "blocks"):
        a, b = (spark.read.parquet(f"{tmp_path}/{x}/{name}") for x in "ab")
        assert dict(a.dtypes) == dict(b.dtypes)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())) and a.count() > 5
    ((counted, table),) = made
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the texts
    assert not spark._jvm.java.io.File(table._textloom_path.removeprefix("file:")).exists()
    assert spark.read.parquet(f"{tmp_path}/b/postings").select(F.input_file_name()).distinct().count() > index.PORTIONS - 2


def test_pairs_of_blocks_come_in_runs(spark, tmp_path, monkeypatch):
    """Each task writes all pairs of an `a` with a block together, by overlap and with rising `b`: about as many runs as
    mentions times blocks; and no block is larger than BLOCK."""
    monkeypatch.setattr(events, "BLOCK", 50)
    sizes, compared = spark.sparkContext.accumulator(0), events._compared

    def noted(a, b, *rest):
        sizes.add(int(max(len(a["id"]), len(b["id"])) > 50))
        return compared(a, b, *rest)

    monkeypatch.setattr(events, "_compared", noted)
    mentions = spark.range(400).select((F.col("id") * 7919 % 1000).alias("id"), F.concat(F.lit("common text of all "), F.when(F.col("id") % 3 == 0, "third ").otherwise(""), F.col("id").cast("string")).alias("text"), F.lit("2024-01-01").alias("date"))
    found = events.blocked_pairs(mentions)
    rows = found.select("a", "b", "overlap", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == 400 * 399 // 2 and all(r.a < r.b for r in rows)
    breaks = sum((x.p, x.a, x.overlap) != (y.p, y.a, y.overlap) or x.b > y.b for x, y in itertools.pairwise(rows))
    assert breaks < 400 * 20 and sizes.value == 0


def test_stored_index_topk_leaves_no_table_of_the_way(spark, tmp_path, monkeypatch):
    """With repeated and null ids it gives what an index in one piece gives, and only the stored index stays."""
    from textloom.operators import search
    from textloom.plans import retrieval

    words = "apache license version of the thing other word".split()
    rows = [(i % 40, " ".join(words[j * (i + 1) % 8] for j in range(i % 13))) for i in range(90)]
    docs = spark.createDataFrame([*rows, (None, "apache license"), (41, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = index.build(tx.with_fold(tx.exploded(docs, "doc_id")), "doc_id")
    want = search.top(search.impacts(index.with_impacts(whole), whole, retrieval.TERMS), 10).collect()
    made, write = [], index.written
    monkeypatch.setattr(index, "written", lambda df: made.append(write(df)) or made[-1])
    assert QUERIES["stored_index_topk"](spark, str(tmp_path)).collect() == want and len(want) == 10
    assert len(made) == 1 and not spark._jvm.java.io.File(made[0]._textloom_path.removeprefix("file:")).exists()
