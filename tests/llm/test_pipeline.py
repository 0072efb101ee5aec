"""The pipeline's stages keep what they should, take effect, and pass the columns of documents on."""

import corpus_pipeline
from textloom.llm import decontam, pii
from textloom.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, written(stage(spark, docs, sf), f"stage{i}")
        if i < 4:
            assert docs.columns == columns
            sizes.append(docs.count())
        if i < 3:
            kept = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.text == kept.get(r.doc_id, r.text) for r in before.collect())
        if i == 2:
            assert decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        if i == 3:
            assert not any(pii.base_spans(r.text) for r in docs.collect()) and docs.where("n_chars <> char_length(text)").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()}


def test_one_document_of_each_group_stays(spark, sf):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text), (1, text), (3, text + " end"), (4, "other text altogether here now"), (4, "other text altogether here now"), (5, None), (6, ""), (None, text), (None, "no id but a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cls string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(1, text), (4, "other text altogether here now"), (5, None), (6, "")] or {r.doc_id for r in kept} == {1, 4, 5, 6, None}
    assert [r.text for r in kept if r.doc_id is None] == ["no id but a text of its own"]


def test_columns_of_any_name_pass_and_the_row_that_stays_is_defined(spark, sf):
    text = " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, gone string, copies string, __key string, key string, doc string, size string"
    rows = [(i, t, "en", "s", 0, x, None, "c", "k", "y", "d", "z") for i, t, x in [(1, text, "b"), (1, text, "a"), (2, text, "a"), (3, "one text", "q"), (None, None, "n"), (4, "", "e"), (4, "", "e")]]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.row) for r in kept.collect()) == [(0, "n"), (1, "a"), (3, "q"), (4, "e")]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, sf), "any")
        assert docs.columns == schema_names(schema)


def schema_names(schema):
    return [x.split()[0] for x in schema.split(", ")]


def test_the_keep_set_of_near_duplicates_is_that_of_all_pairs(spark, sf):
    """The least id of every group of links, found by comparing all pairs of whole texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in docs.collect() if (w := (r.text or "").encode().lower().split())}
    group = {r.doc_id: r.doc_id for r in docs.collect()}
    for a in sorted(sets):
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = {d: lo if g == hi else g for d, g in group.items()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()}
    assert kept == {d for d, g in group.items() if d == g} and len(kept) < len(group)


def test_each_stage_keeps_what_its_operator_says(spark, sf):
    """Keep sets and texts of the stages on one table, worked out row by row from the operators' own results."""
    import re

    from textloom.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    good = {r.doc_id for r in quality.quality(docs, labels).collect() if r.score >= 0.3}
    assert ids(corpus_pipeline.quality_stage(spark, docs, sf)) == sorted(good)
    flat = lambda t: " ".join((t or "").split()).lower()
    held = {r.doc_id for r in docs.collect() if any(flat(b.text) in flat(r.text) for b in items.collect())}
    assert ids(corpus_pipeline.decontamination_stage(spark, docs, sf)) == sorted({r.doc_id for r in docs.collect()} - held)
    spans = {r.id: [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.personal_data(docs).collect()}
    out = {r.doc_id: r.text for r in corpus_pipeline.personal_data_stage(spark, docs, sf).collect()}
    for r in docs.collect():
        kept, far = [], 0
        for a, b, _ in sorted(spans[r.doc_id]):
            kept.append((r.text or "")[far:a]) if a >= far else None
            far = max(far, b)
        left = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", out[r.doc_id] or "") if spans[r.doc_id] else [out[r.doc_id] or ""]
        assert "".join(left) == "".join([*kept, (r.text or "")[far:]])


def test_an_empty_table_goes_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), f"empty{i}")
    assert docs.count() == 0
