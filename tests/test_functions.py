"""Analyzers, dates, locators and cuts, case by case."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import random  # noqa: E402

from textloom.functions import dates, fragments, html, locators
from textloom.functions import text as tx
from textloom.operators import events, grammar, passages, resolve, trees


@pytest.mark.parametrize(("word", "term"), [("Parties", "party"), ("généraux", "general"), ("bureaux", "bureal"), ("jeux", "jeu"), ("causes", "caus"), ("status", "status"), ("hearing", "hear"), ("agreed", "agreed"), ("granted", "grant"), ("notice", "notic"), ("class", "class"), ("bring", "bring")])
def test_fold(spark, word, term):
    assert tx.fold(word) == term
    assert tx.with_fold(spark.createDataFrame([(word,)], "word string")).first()["term"] == term


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formalize", "formal"), ("hopefulness", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert tx.Porter.stem(word) == stem


def test_index_terms():
    assert [tx.index_term(w) for w in ("the", "a", "x" * 33, "hearings", "2024", "hopping")] == [None, None, None, "hear", "2024", "hop"]


def test_queries_are_ranked_or_exact():
    assert grammar.is_ranked("duty of care") and grammar.is_ranked("bread and butter")
    assert not any(map(grammar.is_ranked, ('"duty"', "duty /5 care", "a OR b", "neglig*", "-x", "?!")))
    assert tx.query_terms("The duty, the DUTIES of care") == (["the", "duty", "of", "care"], ["duty", "care"])


@pytest.mark.parametrize(
    ("text", "anchor", "date", "alternatives"),
    [("03/04/2026", None, None, ["2026-04-03", "2026-03-04"]), ("31/03/2026", None, "2026-03-31", ["2026-03-31"]), ("le 10 mars 2026", None, "2026-03-10", []), ("March 10", None, None, []), ("yesterday", "2026-03-12", "2026-03-11", []), ("2024-02-30", None, None, []), ("Fri 3/10/2023", None, "2023-03-10", ["2023-03-10"]), ("5th day of June, 2024", None, "2024-06-05", [])],
)
def test_dates(text, anchor, date, alternatives):
    (found,) = dates.candidates(text, anchor)
    assert (found["date"], found["alternatives"]) == (date, alternatives)


def test_date_heading():
    assert dates.date_heading("[ 10 March 2024 ]:") and not dates.date_heading("On 10 March 2024 we met")


def test_locators(spark):
    rows = spark.createDataFrame([("8(1)(a)",), ("9.1",), ("bad(",)], "l string")
    out = {r["l"]: (r["a"], r["d"], r["p"]) for r in rows.select("l", locators.ancestors(F.col("l")).alias("a"), locators.depth(F.col("l")).alias("d"), locators.parse(F.col("l"))["root_parts"].alias("p")).collect()}
    assert out == {"8(1)(a)": (["8", "8(1)"], 2, [8]), "9.1": ([], 0, [9, 1]), "bad(": ([], 0, None)}
    assert rows.select(locators.page_marker(F.lit("[Page 12]"))).first()[0] == "12"
    assert rows.select(locators.pinpoint(F.lit("section"), F.lit("8"))).first()[0] == "s 8"


def test_paragraphs():
    assert [a for a, _ in passages.cut_paragraphs("Same text.\n\nSame text.\n[3] Third.")] == [0, 12, 23]
    text = "1.1 One\nhas 2.5 metres\n1.2 Two\n3.4 alone"
    assert [text[a:b] for a, b in passages.cut_paragraphs(text)] == ["1.1 One\nhas 2.5 metres", "1.2 Two\n3.4 alone"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "ccc"]), max_size=400), max_size=6))
def test_passages_hold_every_word(lines):
    text = "\n".join(" ".join(x) for x in lines)
    spans = passages.cut_passages(text)
    assert " ".join(" ".join(text[a:b] for a, b in spans).split()) == " ".join(text.split())
    assert all(len(text[a:b].split()) <= passages.MOST for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_windows_cover_the_text():
    text = "One two. Three four! " * 300
    cuts = passages.cut_windows(text, 100)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert max(b - a for a, b in cuts) <= 100
    assert passages.cut_windows("A😀BC🦫D", 3) == [(0, 3), (3, 6)]


def test_merged_spans(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 9, 10), (2, 0, 1)], "k int, start int, end int")
    assert sorted(map(tuple, passages.merged(rows, "k").collect())) == [(1, 0, 5, 2), (1, 9, 10, 1), (2, 0, 1, 1)]


def test_runs_and_chains():
    assert passages.longest_run([1, 9, 2, 4, 3, 7, 5]) == [0, 2, 3, 6]
    assert passages.longest_run([7, 8, 9]) == []
    assert passages.longest_run([1, 3, 2, 3, 4, 5]) == [0, 1, 4, 5]
    rng = random.Random(5)
    for _ in range(300):  # against every start, taken on greedily
        values, best = [rng.randrange(1, 8) for _ in range(rng.randrange(12))], []
        for i, v in enumerate(values):
            run = [i]
            for j in range(i + 1, len(values)):
                if values[run[-1]] < values[j] <= values[run[-1]] + 2:
                    run.append(j)
            best = run if v <= 3 and len(run) > len(best) else best
        assert passages.longest_run(values) == (best if len(best) > 2 else [])


def test_boolean_grammar(spark):
    rows = spark.createDataFrame([(1, "receipt and dispatch"), (2, "receipt"), (3, "the Receipts office")], "id int, text string").withColumn("words", tx.words(F.lower("text"), tx.CORPUS_WORD))
    ids = lambda q: sorted(r[0] for r in grammar.boolean_search(rows, q).select("id").collect())
    assert ids("receipt NOT dispatch") == [2]
    assert ids("receipt*") == [1, 2, 3]
    assert ids('"receipt and" OR office') == [1, 3]
    assert ids("(receipt OR office) AND NOT dispatch") == [2, 3]
    assert ids("dispatch or office") == [1, 3] and ids("receipt and not dispatch") == [2]
    assert ids("ｒｅｃｅｉｐｔ") == [1, 2] and ids("RECEIPT NOT NOT dispatch") == [1]
    for bad in ("", "(a", "a)", "NOT", "a OR", 'a "b', 'a ""', "mid*dle", "*a", "AND a", "a AND AND b", "?!"):
        with pytest.raises(grammar.Syntax):
            grammar.parse_boolean(bad)


def shape(tree):
    near = f"{tree.kind}{tree.distance or ''}{'!' if tree.negated else ''}"
    return tree.text if tree.op == "TERM" else (tree.op if tree.op != "NEAR" else near, *map(shape, tree.args))


def test_proximity_precedence():
    read = lambda q: shape(grammar.parse_proximity(q))
    assert read("a /p b /3 c") == ("p", "a", ("n3", "b", "c")) and read("a /3 b /p c") == ("p", ("n3", "a", "b"), "c")
    assert read("a /s b /p c /2 d OR e") == ("p", ("s", "a", "b"), ("n2", "c", ("OR", "d", "e")))
    assert read('lease -"oral"') == read("lease -oral") == read("lease NOT oral") == read("-oral lease") == ("NOT", "lease", "oral")
    assert read("lease - oral") == ("NOT", "lease", "oral") and read("a b NOT c d") == ("AND", ("AND", "a", ("NOT", "b", "c")), "d")
    assert read("a /p NOT b") == read("NOT b /p a") == ("p!", "a", "b") and read("a /3 (b OR c)") == ("n3", "a", ("OR", "b", "c"))
    assert read("a and b or c") == ("AND", "a", ("OR", "b", "c")) and read("exact(X y) a") == ("AND", "x y", "a")
    for bad in ("NOT a NOT b", "a OR NOT b", "a -", 'a "b', 'a ""', "EXACT(a", "EXACT( )", "a /x b", "mid*dle", "a /1234 b", "a ) b", "/3 a"):
        with pytest.raises(grammar.Syntax):
            grammar.parse_proximity(bad)


def test_proximity_grammar(spark):
    rows = [(1, 0, 0, i, w) for i, w in enumerate("the court gave written notice to all parties".split())] + [(2, 0, 0, 0, "notice"), (2, 1, 0, 0, "court")]
    tokens = tx.with_fold(spark.createDataFrame(rows, "doc int, para int, sent int, pos int, word string")).cache()
    found = lambda q: sorted((r.doc, r.para, r.first, r.last) for r in grammar.spans(grammar.parse_proximity(q), tokens).collect())
    assert found("court /3 notice") == [(1, 0, 1, 4)]
    assert found("court /2 notice") == []
    assert found("notice /p courts") == [(1, 0, 1, 4)]
    assert found('"written notice" /9 party') == [(1, 0, 3, 7)]
    assert found("notice NOT party") == [(2, 0, 0, 0)]
    assert found("notice /3 NOT court") == [(2, 0, 0, 0)]
    assert found("EXACT(parties)") == [(1, 0, 7, 7)] and found("EXACT(party)") == []
    assert found("writ* OR gave") == [(1, 0, 2, 2), (1, 0, 3, 3)]
    assert found("notice AND court") == [(1, 0, 1, 1), (1, 0, 4, 4), (2, 0, 0, 0), (2, 1, 0, 0)]
    assert found("court /p gave /9 notice")[0] == (1, 0, 1, 4)
    assert found("party /3 given OR gave") == [] and found("court -parties") == [(2, 1, 0, 0)]
    few = grammar.hits(grammar.parse_proximity("notice -party"), tokens)
    assert few.count() == 3 and grammar.search(grammar.parse_proximity("notice -party"), tokens).count() == 1
    for bad in ("", "a /3", "NOT a", "(a", "x " * 65):
        with pytest.raises(grammar.Syntax):
            grammar.parse_proximity(bad)


def test_clusters_keep_numbers_apart():
    same = "The inspector delivered the written report"
    assert events.cluster([("1", same, "2024-01-01"), ("2", same + " today", "2024-01-01"), ("3", same, "2024-01-02")]) == [0, 0, 1]
    assert events.cluster([("1", "Paid invoice 17 in full by cheque", "2024-01-01"), ("2", "Paid invoice 93 in full by cheque", "2024-01-01")]) == [0, 1]
    assert events.cluster([("1", same, ""), ("2", same, "")], {frozenset(("1", "2"))}) == [0, 1]


def test_screen(spark):
    cases = {"12 34 !!": "fragment", "Notice of motion": "heading or label", "THE WHOLE OF THIS LINE IS IN UPPER CASE LETTERS NOW.": "heading or label", "This e-mail is for the intended recipient only and nobody else at all.": "disclaimer", "Our office is at Main Street, reach Ann at ann@example.com any time.": "contact details", "The tribunal heard the appeal and allowed it in part with costs.": ""}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.got == r.want for r in rows.select("want", events.screen(F.col("t")).alias("got")).collect())


def test_document_entry():
    assert events.document_entry("Subject: Sale of the land\nDate: 3 May 2024\nDear sir") == ("2024-05-03", "Sale of the land")
    assert events.document_entry("no date here") is None


def test_html():
    page = "<html><head><title>x</title></head><body><p>One<br><br>Two &amp; three<script>no</script></p><ul><li>Four</li></ul>tail</body></html>"
    assert [t for _, t in html.read_blocks(page)[0]] == ["One", "Two & three", "Four", "tail"]
    long = "<p>" + "x" * 70_000 + "</p><p>y</p>"
    assert [len(t) for _, t in html.read_blocks(long)[0]] == [70_000, 1] and not html.read_blocks(long)[1]
    assert html.read_blocks(long, most_block=65_536) == ([("p", "y")], True) and html.read_blocks(long, most_text=70_000)[1]


def test_fragments():
    text = "The quick brown fox. The quick red fox jumps over the lazy dog."
    assert fragments.find(text, ":~:text=The%20quick,dog") == (0, 62)
    assert fragments.find(text, "fox.-,The,-quick red") in (None, (21, 24))
    for a, b in ((4, 9), (21, 38), (39, 62)):
        made = fragments.make(text, a, b)
        got = fragments.find(text, made)
        assert text[got[0] : got[1]] == text[a:b]
    assert fragments.parse("https://x/y#:~:text=a-,b,c,-d") == {"prefix": "a", "start": "b", "end": "c", "suffix": "d"}


def test_resolution(spark):
    rows = spark.createDataFrame([("k", "i1", "astat", "t", "t"), ("k", "i2", "stat", "u", "t"), ("m", "i3", "stat", "a", "z"), ("m", "i4", "stat", "b", "z"), ("n", "i5", "stat", "a", "b"), ("n", "i6", "stat", "b", "b")], "key string, id string, path string, title string, wanted string")
    assert {r.key: r.id for r in resolve.chosen(rows, "key").collect()} == {"k": "i2", "n": "i6"}


def test_forest(spark):
    folders = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone")], "id string, parent string")
    closed = trees.closure(folders)
    assert sorted((r.id, r.ancestor) for r in closed.where("distance > 0").collect()) == [("b", "a"), ("c", "a"), ("c", "b")]
    filings = spark.createDataFrame([(1, "a"), (1, "c"), (2, "b")], "doc int, folder string")
    assert {r.folder: r.docs for r in trees.counts(filings, closed).collect()} == {"a": 2, "b": 2, "c": 1}
    assert sorted((r.doc, r.folder) for r in trees.shown(filings, closed).collect()) == [(1, "c"), (2, "b")]


def test_sentences_keep_abbreviations_and_initials(spark):
    cases = {
        "Mr. Smith met Dr. Who. He said no.": 2, "See s. 8 and paras. 9 there. Then art. 10!": 2, "A.B. 12 stands. A.B. Stands too.": 3, "It ended. and went on.": 1, '"Stop." He left.': 2, "One.\n\nTwo": 2, "word " * 300: 2, "x" * 2500: 3,
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, n int").select("t", "n", passages.sentences(F.col("t")).alias("s"))
    assert [(r.t[:20], len(r.s)) for r in rows.collect()] == [(t[:20], n) for t, n in cases.items()]


def test_closure_reaches_the_end_of_long_paths(spark):
    path = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(150)], "id string, parent string")
    assert trees.closure(path).agg(F.max("distance")).first()[0] == 149


def test_supreme_court_stands_for_itself(spark):
    rows = spark.createDataFrame([(1, 2001, 2002, "ONCA", "SCC"), (2, 2001, 2002, "scc", "CSC"), (3, 2001, 2004, "SCC", "SCC"), (4, 2001, 2000, None, "ONCA")], "k int, base_year int, year int, a string, b string")
    assert sorted(r.k for r in resolve.plausible(rows).collect()) == [1, 2, 4]
    assert sorted(r.k for r in resolve.plausible(rows, base_court="a", court="b").collect()) == [2, 4]


def test_provision_chains_and_reflow(spark):
    marks = spark.createDataFrame([(i, r, x) for i, (r, x) in enumerate([(0, "1"), (1, "a"), (1, "b"), (0, "2"), (2, "i"), (1, "c"), (2, "ii")])], "n int, rank int, label string").withColumn("doc", F.lit(1))
    got = [r.chain for r in passages.provision_chains(marks, "doc", order="n").orderBy("n").collect()]
    assert got == [["1"], ["1", "a"], ["1", "b"], ["2"], ["2", "i"], ["2", "c"], ["2", "c", "ii"]]
    lines = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 12.0, 10.0, "b"), (1, 50.0, 10.0, "c")], "doc int, y double, height double, text string")
    assert sorted((r.paragraph, r.text) for r in passages.reflowed(lines, "doc").collect()) == [(0, "a b"), (1, "c")]
