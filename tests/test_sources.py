"""Readers, writers, the stored index and the streams."""

import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import index, search
from textloom.sources import readers, writers
from textloom.streaming import incremental


def test_layouts(spark, tmp_path):
    a = spark.createDataFrame([("c1", "Text one", None), ("c2", "", "Texte")], "Citation_EN string, unofficial_text_en string, unofficial_text_fr string")
    out = readers.projected(a).collect()
    assert [(r.citation, r.text_en, r.text_fr, r.title) for r in out] == [("c1", "Text one", "", ""), ("c2", "", "Texte", "")]
    with pytest.raises(readers.NoText):
        readers.projected(spark.createDataFrame([(1,)], "x int"))
    a.coalesce(1).write.parquet(f"{tmp_path}/laws/p")
    rows = readers.corpus(spark, f"{tmp_path}/laws").collect()
    assert [r.row_index for r in rows] == [0, 1] and {r.doc_type for r in rows} == {"legislation"} and len({r.file_id for r in rows}) == 1
    good, bad = readers.register(spark, [f"{tmp_path}/laws", f"{tmp_path}/none"])
    assert list(good) == [f"{tmp_path}/laws"] and list(bad) == [f"{tmp_path}/none"]


def test_tab_separated(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("# head\n1\ta\tp\nshort\n2\tb\tq\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "i.tsv"), ["id", "db", "path"]).orderBy("id").collect()] == [("1", "a", "p"), ("2", "b", "q")]
    (tmp_path / "p.tsv").write_text("#p1\thttps://x/\n#p2\thttps://y/\nk1\t1:one\nk2\t2:two:2\n")
    assert {r.key: r.item for r in readers.prefixed_tsv(spark, str(tmp_path / "p.tsv")).collect()} == {"k1": "https://x/one", "k2": "https://y/two:2"}


def word_file(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    doc = word_file("<w:p><w:r><w:t>Paid </w:t></w:r><w:del><w:r><w:delText>15</w:delText></w:r></w:del><w:ins><w:r><w:t>13</w:t></w:r></w:ins></w:p>")
    assert [b["text"] for b in readers.read_word(doc)] == ["Paid 13"] and [b["text"] for b in readers.read_word(doc, "original")] == ["Paid 15"]
    mail = EmailMessage()
    mail["From"], mail["Subject"] = "a@example.com", "Sale"
    mail.set_content("First.\n\nSecond.")
    mail.add_attachment(doc, maintype="application", subtype="octet-stream", filename="n.docx")
    (tmp_path / "m.eml").write_bytes(bytes(mail))
    (tmp_path / "copy.eml").write_bytes(bytes(mail))
    (tmp_path / "t.html").write_text("<p>One</p><p>Two</p>")
    out = {r.name: [b.text for b in r.blocks] for r in readers.files(spark, str(tmp_path)).collect()}
    assert len(out) == 2 and out["t.html"] == ["One", "Two"]
    assert next(v for k, v in out.items() if k.endswith("eml")) == ["a@example.com", "Sale", "First.", "Second.", "Paid 13"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=HYPERLINK(1)", 'say "x"', None)], "a string, b string, c int")
    assert writers.csv_lines(rows).first()[0] == '"\'=HYPERLINK(1)","say ""x""",""'
    writers.write_csv(rows, f"{tmp_path}/c")
    (head,) = (tmp_path / "c_head").glob("part-*")
    assert head.read_bytes() == '\ufeff"a","b","c"\r\n'.encode()
    assert writers.write_tsv(rows, f"{tmp_path}/t") == writers.write_tsv(rows, f"{tmp_path}/t2")
    sizes = spark.createDataFrame([("a", 6), ("b", 5), ("c", 4), ("d", 9)], "name string, size long")
    assert [r.grp for r in writers.packed_groups(sizes, 10).orderBy("name").collect()] == [0, 1, 1, 2]
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "B", False), (1, None, True), (3, "c", None)], "k int, v string, gone boolean")
    assert sorted(map(tuple, writers.merged(table, changes, "k", "gone").collect())) == [(2, "B"), (3, "c")]
    writers.write_sharded(table, f"{tmp_path}/s", ["v", "k"])
    assert spark.read.parquet(f"{tmp_path}/s").where("v = 'a'").count() == 1


def test_stored_index(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    built = index.build(tx.with_fold(tx.exploded(docs, "doc_id")), "doc_id")
    index.write(built, str(tmp_path / "i"), 4)
    stored = index.read(spark, str(tmp_path / "i"))
    terms, _ = tx.query_terms("license version the")
    want = search.top(search.bm25(built, terms), 5).collect()
    assert search.top(search.bm25(stored, terms), 5).collect() == want
    assert search.ranked_scan(docs, "license version the", 5, "doc_id").collect() == [type(r)(*r) for r in want]
    for k in (1, 5, 40, 10**6):
        for first in (1, 16):
            pruned = search.pruned_topk(stored, index.read_blocks(spark, str(tmp_path / "i")), terms, k, first).collect()
            assert pruned == search.top(search.impacts(stored.postings, stored, terms), k).collect()
    plan = search.only(stored.postings, terms, stored=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan
    assert search.missing(stored, ["the", "qqqq"]) == ["qqqq"]


def test_upserts_can_be_tried_again(spark, tmp_path):
    kept = incremental.Upserts(spark, str(tmp_path / "t"), "k", "seq", "gone")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, seq int, v string, gone boolean")
    kept.apply(frame((1, 1, "a", False), (2, 1, "b", False)), 0)
    for _ in range(2):
        kept.apply(frame((1, 3, "A", False), (2, 2, None, True)), 1)
    kept.apply(frame((1, 2, "late", False)), 2)
    assert [tuple(r) for r in kept.current().select("k", "v").collect()] == [(1, "A")]


def test_snapshots_are_checked(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"one")
    (tmp_path / "y.bin").write_bytes(b"two!")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    files = [{"path": "a/x.bin", "size": 3, "sha256": sha(b"one").upper()}, {"path": "y.bin", "size": 3, "sha256": sha(b"two")}, {"path": "z.bin", "size": 0, "sha256": sha(b"")}]
    assert {r.path: r.intact for r in readers.snapshot(spark, str(tmp_path), files).collect()} == {"a/x.bin": True, "y.bin": False, "z.bin": False}


def test_upserts_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    kept = incremental.Upserts(spark, str(tmp_path / "t"), "k", "seq")
    for n in range(7):
        for _ in range(2):  # every batch is tried twice
            kept.apply(spark.createDataFrame([(n % 3, n, f"v{n}"), (9, 0, "first")], "k int, seq int, v string"), n)
    assert sorted(tuple(r) for r in kept.current().select("k", "v").collect()) == [(0, "v6"), (1, "v4"), (2, "v5"), (9, "first")]
    names = {p.name for p in (tmp_path / "t").iterdir()}
    assert "v5" in names and "d6" in names and not names & {"d0", "d1", "v1"}


def test_generic_text_goes_by_language(spark):
    df = spark.createDataFrame([("a", "Fr", "bonjour"), ("b", "en", "hello")], "ID string, Language string, speech_text string")
    assert [(r.text_en, r.text_fr, r.citation) for r in readers.projected(df).collect()] == [("", "bonjour", "a"), ("hello", "", "b")]


def test_many_queries_go_in_blocks(spark, sf, monkeypatch):
    from textloom.operators import nearest

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = rows.where("vec_id < 7").select(rows.vec_id.alias("query_id"), rows.embedding.alias("query"))
    want = sorted(map(tuple, nearest.search(rows, asked, 3).collect()))
    monkeypatch.setattr(nearest, "QUERIES", 2)
    assert sorted(map(tuple, nearest.search(rows, asked, 3).collect())) == want


def test_gaps_cross_ranges(spark):
    rows = spark.createDataFrame([("a", p) for p in (0, 3, 4, 9, 17, 18)] + [("b", 12)], "term string, pid long")
    assert sorted((r.term, r.pid, r.gap) for r in index.gaps(rows, 4).collect()) == [("a", 0, 0), ("a", 3, 2), ("a", 4, 0), ("a", 9, 4), ("a", 17, 7), ("a", 18, 0), ("b", 12, 12)]
