"""Each operator against a plain version of itself, and on odd rows: nulls, empty and long texts, repeats, no rows,
extra columns with clashing names."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import chat, decontam, hmm, jaccard, license, pack, pii, quality, queries, shard, vectors, wordhash
from textloom.llm.common import components

CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, cls long, x string, score string, n int, key string, component string, row string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def odd(spark, rows):
    """Documents (id, text) with every other column of a clashing name."""
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, 2, "x", "s", 3, "k", "c", "r") for i, t in rows], CLASH)


LONG = " ".join(f"word{i % 977}" for i in range(30000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "alpha beta gamma delta epsilon"), (5, "alpha beta gamma delta epsilon"), (6, LONG), (None, "alpha beta gamma delta epsilon"), (None, None), (7, "ünïcode “quotes” 😀 naïve façade déjà vu encore")]


def least_components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Shared pieces.


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0bABab é中😀\xa0", max_size=12) | st.none(), max_size=6))
def test_words_are_those_of_bytes_split(texts):
    seen: dict[bytes, int] = {}
    at = 0
    for a, b, h, n in wordhash.words(pa.array(texts, pa.string())):
        assert a == at
        at = b
        for i in range(b - a):
            want = (texts[a + i] or "").encode().lower().split()
            got = h[n[i] : n[i + 1]].tolist()
            assert len(got) == len(want)
            assert all(seen.setdefault(w, g) == g for w, g in zip(want, got, strict=True))
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_long_columns_are_cut_between_texts(monkeypatch):
    monkeypatch.setattr(wordhash, "CHUNK", 10)
    texts = ["a b", "c" * 50, "", "d e f g h i j k"] * 3
    sizes = [n for _, _, h, w in wordhash.words(pa.array(texts)) for n in np.diff(w).tolist()]
    assert sizes == [2, 1, 0, 8] * 3


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(i, 99 - i) for i in range(50)] + [(3, 5), (5, 97)], [(7, 7), (2, 1), (1, 2)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = least_components({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n != c or n in {want[m] for m in want if m != want[m]}}


# 1. Hilbert sharding.


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = shard.hilbert(points, bits)
        assert sorted(index) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()


def check_shards(rows, texts):
    assert len(rows) == len(texts)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_shards(spark, sf, texts, tmp_path):
    rows = queries.op1_hilbert_sharding(spark, sf).collect()
    check_shards(rows, texts.items())
    assert [r.curve_index for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(r.curve_index for r in rows)
    odd(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    check_shards(queries.op1_hilbert_sharding(spark, str(tmp_path)).collect(), ODD)
    odd(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op1_hilbert_sharding(spark, f"{tmp_path}/none").collect() == []


def test_shards_are_runs_of_the_curve(spark, monkeypatch):
    """Curve index, order and cut recomputed plainly, with columns of clashing names and cells cut into bins."""
    monkeypatch.setattr(shard, "LEAST_BIN", 7)
    rng = np.random.default_rng(1)
    data = [(i, int(x), int(y), str(z)) for i, (x, y, z) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 2, 300) * 3, rng.integers(0, 2, 300), strict=True))]
    df = spark.createDataFrame(data, "cell long, first int, rank int, shard string")
    got = shard.shards(F.struct("cell", "shard"), [F.col("first"), F.col("rank")], F.col("cell"), 7, df, bits=2).collect()
    curve = dict(zip([r[0] for r in data], shard.hilbert(np.array([r[1:3] for r in data]), 2).tolist(), strict=True))
    line = sorted(got, key=lambda r: (r.shard, r.slot))
    assert sorted(r.row.cell for r in got) == list(range(300)) and all(r.curve == curve[r.row.cell] for r in got)
    assert [r.curve for r in line] == sorted(curve.values())
    assert [(r.shard, r.slot) for r in line] == [(s, k) for s in range(7) for k in range(300 // 7 + (s < 300 % 7))]
    assert len({(r.curve) for r in got}) == 8


def test_bits_follow_the_rows():
    assert [shard.bits_for(n, 4) for n in (0, 10**4, 10**9)] == [3, 3, 4] and shard.bits_for(10**8, 2) == 8
    assert shard.CELLS == 16


# 2. Decontamination.


def test_verbatim_items_are_found_and_nothing_else(spark, sf, docs, texts):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join(t.split()).lower()
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if flat(r.text) in flat(t)}
    got = {(r.id, r.item) for r in decontam.contaminated(docs, items).collect()}
    assert got == want and want


QUESTION = "Yesterday the farmer Alice sold 12 baskets of 5 kg each to Robert, and then Alice walked 3 miles home before the evening market closed for the day."


def test_templates(spark):
    items = spark.createDataFrame([(0, QUESTION), (1, ""), (2, None), (3, "a b")], "item_id int, text string")
    cases = {
        1: QUESTION,
        2: "Intro text here. " + QUESTION.replace("Alice", "Maria").replace("Robert", "Joseph").replace("12", "40").replace("3 miles", "9 km"),
        3: QUESTION.replace("Alice sold", "Maria sold").replace("then Alice", "then Peter"),  # one name, two fillers
        4: "Yesterday the farmer walked home and the market closed.",
        5: QUESTION.upper() * 0 + "some words before it " + QUESTION.replace("\n", " ") + " and after it",
        6: None,
        7: "",
    }
    found = decontam.contaminated(odd(spark, cases.items()), items).collect()
    assert {(r.id, r.item) for r in found} == {(1, 0), (2, 0), (5, 0)}
    kept = decontam.clean(odd(spark, cases.items()), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7] and kept.columns == odd(spark, []).columns
    assert decontam.contaminated(odd(spark, []), items).collect() == []
    assert decontam.contaminated(odd(spark, ODD), items.where("false")).collect() == []
    twice = [(None, QUESTION), (None, "clean text of a row without id"), (9, QUESTION), (9, QUESTION)]
    assert sorted(r.text for r in decontam.clean(odd(spark, twice), items).collect()) == ["clean text of a row without id"]


def test_slots_are_read_from_the_text():
    data = np.frombuffer("In 2024 Bob ran 3.5 km. Three men saw it".encode(), np.uint8)
    start, stop, _, kinds, _ = decontam.canonical(data, np.array([0, len(data)]))
    assert [(bytes(data[a:b]).decode(), int(k)) for a, b, k in zip(start, stop, kinds, strict=True) if k] == [("2024", 1), ("Bob", 3), ("3.5", 1), ("km", 2), ("Three", 1)]


def found_in(spark, items, cases):
    rows = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    return {(r.id, r.item) for r in decontam.contaminated(odd(spark, list(enumerate(cases))), rows).collect()}


def test_copies_with_few_literals(spark):
    items = ["What is 12 + 34 + 56 + 78?", "12 kg 15 kg 19 kg 23 kg 31 kg 44 kg", "法国的首都是哪个城市？请写出它的名字。", "Which red planet has two moons?", "zyzzyva 17", "“Name seven very old rivers”"]
    cases = [f"Some words before. {items[0]} And after.", f"so {items[1]} it was", f"前面的话，{items[2]}后面的话", "Question: Which red planet has two moons? Mars.", "a Zyzzyva 17 there", 'say "Name seven very old rivers" now', "What is 13 + 34 + 56 + 78? 法国的人口是多少？ A planet of two moons, 12 kg 15 kg and zyzzyva 18."]
    assert found_in(spark, items, cases) == {(i, i) for i in range(6)}


def test_fillers_agree_across_alignments(spark):
    """One name with two fillers is no copy of the item, also where words between the halves shift the second one."""
    item = "the farmer Alice went over some fields and then came in the old neighbour Alice with bags and called"
    halves = item.split()[:10], item.split()[10:]
    said = lambda a, b, between: " ".join(halves[0]).replace("Alice", a) + between + " ".join(halves[1]).replace("Alice", b)
    between = " while it rained a bit "
    got = found_in(spark, [item], [said("Maria", "Maria", between), said("Maria", "Peter", between), said("Maria", "Maria", " "), said("Maria", "Peter", " ")])
    assert got == {(0, 0), (2, 0)}


def test_templates_agree_with_a_plain_version(spark):
    """Random items with other fillers: one alignment, all windows in plain Python."""
    rng = np.random.default_rng(12)
    names, words = ["Alice", "Bob", "Carol", "Dan"], "takes sells gives from under over with some red green old".split()
    kind = lambda w: "#" if w.isdigit() else "@" if w in names else w
    items = [["so"] + [str(rng.choice([rng.choice(names), rng.integers(2, 99), *rng.choice(words, 4)])) for _ in range(12)] for _ in range(25)]
    texts = []
    for item in items:
        fill = {n: rng.permutation(names)[0] for n in names} | {str(n): str(n + rng.integers(0, 2)) for n in range(100)}
        other = [fill.get(w, w) if rng.random() < 0.95 else "changed" for w in item]
        if rng.random() < 0.4:
            other[int(rng.integers(1, 13))] = "Alice"
        texts.append(other)

    def plain(item, text):
        n, size = len(item), decontam.WINDOW
        same = [p for p in range(n - size + 1) if item[p : p + size] == text[p : p + size]]
        like = [p for p in range(n - size + 1) if [kind(w) for w in item[p : p + size]] == [kind(w) for w in text[p : p + size]] and sum(kind(w) == w for w in item[p : p + size]) >= decontam.LITERALS]
        pairs = {(kind(item[i]) + item[i], text[i]) for p in like for i in range(p, p + size) if kind(item[i]) != item[i]}
        pos = set(same) | (set(like) if len(pairs) == len({a for a, _ in pairs}) else set())
        return len({i for p in pos for i in range(p, p + size)}) / n >= decontam.COVERAGE or any(all(p + j in pos for j in range(decontam.RUN - size + 1)) for p in pos)

    got = found_in(spark, [" ".join(i) for i in items], [" ".join(t) for t in texts])
    want = {(i, i) for i, (a, b) in enumerate(zip(items, texts, strict=True)) if plain(a, b)}
    assert {(a, b) for a, b in got if a == b} == want and 3 < len(want) < 24


def test_first_word_is_name_or_literal(spark):
    item = "Divide 36 apples among the 4 children there"
    assert found_in(spark, [item], ["Task: " + item.replace("36", "48").replace("4 ", "6 "), "Task: divide the apples"]) == {(0, 0)}


def test_long_runs_are_leaks_whatever_their_share(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    run = lambda a, n: "before it " + " ".join(words[a : a + n]) + " after it"
    assert found_in(spark, [" ".join(words), " ".join(words[:59])], [run(70, 119), run(20, 35), run(90, 13), run(90, 12)]) == {(0, 0), (1, 0), (1, 1), (2, 0)}


# 3. Personal data.

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def luhn(s):
        d = [int(c) for c in s if c in "0123456789"][::-1]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    fits = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": luhn, "phone": lambda s: 9 <= sum(c in "0123456789" for c in s) <= 15}
    return [(i, m.start(), m.end()) for i, k in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[k], text) if fits[k](m[0])]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+0159 ()é", max_size=40) | st.lists(st.sampled_from(["4111111111111111", "+1 (375) 555-4393", "10.0.0.255", "300.1.1.1", "a.b@c.de", "x@y", " ", "-", ".", "@"]), max_size=8).map("".join))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark, docs, texts):
    rows = pii.personal_data(docs).collect()
    for r in rows:
        base = plain_spans(texts[r.id])
        assert r.base_sha256 == hashlib.sha256(pii.said(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(pii.said(base).split(",")) - {""} <= set(r.spans.split(","))
    assert sum(r.n_email for r in rows)


def test_repeated_mentions_get_the_label_of_the_first(spark):
    noise = [(100 + i, f"version {i}.0 of part {i} costs {i * 7} in {1900 + i}") for i in range(40)]
    seen = [(i, f"Call +1 (649) 555-16{i:02d} or mail ann.lee{i}@example.com now") for i in range(30)]
    text = "Call +1 (649) 555-1648 today. " + "Some more words here. " * 40 + "As said, 649-555-1648 is the number; ask for zoe.park or zoe.park@example.com. Room 12 on floor 3."
    rows = {r.id: r for r in pii.personal_data(odd(spark, [*noise, *seen, (1, text), (2, None), (3, "")])).collect()}
    added = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in rows[1].spans.split(",")) if (pii.KINDS.index(k), int(a), int(b)) not in plain_spans(text)}
    assert added == {"649-555-1648", "zoe.park"}
    assert all(rows[i].spans == "" for i, _ in noise) and rows[2].spans == rows[3].spans == ""
    out = {r.doc_id: r.text for r in pii.masked(odd(spark, [(1, text), *seen, *noise])).collect()}
    assert "555" not in out[1] and "example.com" not in out[1] and "[PHONE]" in out[1] and out[100] == noise[0][1]


def test_labels_reach_the_end_of_a_skip_chain():
    far = pii.Graph()
    text = "Call +1 (649) 555-1648 now. " + ("More words stand here, so that no units are neighbours. " + "Or 649-555-1648 it is. ") * 400
    far.add(0, text, pii.base_spans(text))
    far.add(1, "Room 12 on floor 3", [])
    unary, skip = np.log(np.full((pii.SHAPES, pii.LABELS), 0.2)), 8.0 * np.eye(pii.LABELS)
    belief = pii.infer(far, unary, np.stack((np.zeros_like(skip), skip)))
    assert far.label[0] == 4 and len(belief) == 403
    # The field of one text is a chain here, so the marginals are powers of its normalised transitions.
    step = np.exp(skip) / np.exp(skip).sum(1, keepdims=True)
    want = [np.linalg.matrix_power(step, i)[4] for i in range(401)]
    assert np.abs(belief[:401] - want).max() < 1e-2 and np.abs(belief[401:] - 0.2).max() < 1e-9


def _field(rng, units, edges):
    g = pii.Graph()
    g.text, g.shape, g.label = [0] * units, rng.integers(0, pii.SHAPES, units).tolist(), [0] * units
    g.sweeps, g.edges = [400] * units, edges
    unary = np.log(rng.dirichlet(np.ones(pii.LABELS), pii.SHAPES))
    pairs = rng.normal(0, 1, (2, pii.LABELS, pii.LABELS))
    return g, unary, pairs


def _marginals(g, unary, pairs):
    """By all labelings of a small field."""
    n = len(g.shape)
    out = np.zeros((n, pii.LABELS))
    for own in itertools.product(range(pii.LABELS), repeat=n):
        if all(not seen or own[i] == seen for i, seen in enumerate(g.label)):
            p = math.exp(sum(0 if g.label[i] else unary[g.shape[i], k] for i, k in enumerate(own)) + sum(pairs[kind][own[a], own[b]] for kind in range(2) for a, b in g.edges[kind]))
            for i, k in enumerate(own):
                out[i, k] += p
    return out / out.sum(1, keepdims=True)


def test_beliefs_are_marginals_where_no_path_closes():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        tree = [(int(rng.integers(0, i)), i) for i in range(1, 6)]
        kinds = rng.integers(0, 2, 5)
        g, unary, pairs = _field(rng, 6, tuple([e for e, k in zip(tree, kinds, strict=True) if k == kind] for kind in range(2)))
        g.label[int(rng.integers(0, 6))] = int(rng.integers(1, pii.LABELS))
        assert np.abs(pii.infer(g, unary, pairs) - _marginals(g, unary, pairs)).max() < 1e-3


def test_loopy_beliefs_are_those_of_a_plain_loop():
    for seed in range(8):
        rng = np.random.default_rng(100 + seed)
        g, unary, pairs = _field(rng, 6, ([(i, i + 1) for i in range(5)], [(0, 3), (1, 4), (3, 5)]))
        pairs *= 0.4
        own = np.exp(unary[g.shape])
        sent = {(a, b, kind): np.ones(pii.LABELS) for kind in range(2) for x, y in g.edges[kind] for a, b in ((x, y), (y, x))}
        for _ in range(300):
            new = {}
            for a, b, kind in sent:
                psi = np.exp(pairs[kind] if (a, b) in g.edges[kind] else pairs[kind].T)
                into = own[a] * np.prod([m for (c, d, _), m in sent.items() if d == a and c != b], axis=0) if any(d == a and c != b for c, d, _ in sent) else own[a]
                new[a, b, kind] = (into @ psi) / (into @ psi).sum()
            sent = new
        want = np.array([own[i] * np.prod([m for (_, d, _), m in sent.items() if d == i], axis=0) for i in range(6)])
        assert np.abs(pii.infer(g, unary, pairs) - want / want.sum(1, keepdims=True)).max() < 1e-2


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000 + "x", "a" * 200_000 + " @ b", "1." * 100_000, "+1" + "." * 200_000, "1 " * 100_000):
        pii.find(pa.array([text]), np.zeros((pii.SHAPES, pii.LABELS)), np.zeros((2, pii.LABELS, pii.LABELS)))


def test_personal_data_on_odd_rows(spark):
    assert len(pii.personal_data(odd(spark, ODD)).collect()) == len(ODD)
    assert pii.personal_data(odd(spark, [])).collect() == []
    assert pii.masked(odd(spark, ODD)).columns == odd(spark, []).columns


# 4. Embeddings.


def plain_vectors(rows, cosine=0.98):
    usable = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = []
    for (a, la, va), (b, lb, vb) in itertools.combinations(rows, 2):
        if la is not None and la == lb and usable(va) and usable(vb) and len(va) == len(vb):
            x, y = np.array(va, float), np.array(vb, float)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                links.append((a, b))
    return Counter(x for p in links for x in p), least_components([r[0] for r in rows], links)


def check_vectors(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, cls string, n int")
    found = vectors.near_vectors(df).collect()
    n, component = plain_vectors([tuple(r)[:3] for r in df.collect()])
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in found} == {r[0]: (n[r[0]], component[r[0]], r[0] == component[r[0]]) for r in rows}


def test_vectors(spark, sf):
    check_vectors(spark, [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_classes_of_one_number_are_told_apart(spark, monkeypatch):
    """Another seed is taken where two classes have one number; labels that start alike stay apart."""
    made = vectors._class
    monkeypatch.setattr(vectors, "_class", lambda label, x, seed: (5, made(label, x, seed)[1]) if not seed else made(label, x, seed))
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, "long label " * 9 + str(i % 2), (base + 0.02 * rng.standard_normal(8)).tolist()) for i in range(20)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")).collect()
    assert {r.id: r.component_id for r in found} == {i: i % 2 for i in range(20)}


def test_hot_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    near = [(i, 1, (base + 0.1 * rng.standard_normal(16)).tolist()) for i in range(120)]
    copies = [(200 + i, 1, near[0][2]) for i in range(30)]
    rest = [(300 + i, i % 3, rng.standard_normal(16).tolist()) for i in range(60)]
    strange = [(400, 1, None), (401, 1, [0.0] * 16), (402, 1, [math.nan] * 16), (403, None, near[0][2]), (404, None, near[0][2]), (405, 1, []), (406, 1, [None] * 16), (407, 2, near[0][2]), (408, 1, near[0][2][:15]), (409, 1, [x * 1e3 for x in near[0][2]]), (410, 1, [math.inf] * 16)]
    check_vectors(spark, near + copies + rest + strange)
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vectors.near_vectors(empty).collect() == []
    (row,) = vectors.near_vectors(spark.createDataFrame([(None, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")).collect()
    assert (row.id, row.n_links, row.component_id, row.kept) == (None, 0, None, False)


def test_plan_keeps_recall():
    for n in (10, 10**4, 10**8):
        k, tables = vectors.plan(n, 0.98)
        assert 1 - (1 - vectors.meets(0.2, vectors.WIDTH) ** k) ** tables >= vectors.RECALL


# 5. Jaccard join.


def plain_groups(rows, k, num, den):
    def shingled(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = [(i, shingled(t)) for i, t in rows]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and den * len(x & y) >= num * len(x | y)]
    return {i: (len(s), c) for (i, s), c in zip(sets, least_components([i for i, _ in sets], links).values(), strict=True)}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_groups(docs, texts, k, num):
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, k=k, num=num).collect()}
    assert got == plain_groups(texts.items(), k, num, 100)


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):  # near copies around the threshold
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            words[at] = f"e{i}_{at}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[0][1]) for i in range(10)]
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(300 + i, " ".join(f"o{i}_{j}" for j in range(rng.integers(5, 60))) + " " + shared) for i in range(40)]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(odd(spark, rows), k=3, num=90).collect()}
    want = plain_groups(rows, 3, 90, 100)
    assert got == want and len({c for _, c in want.values()}) > 3


def test_a_passage_of_many_unlike_texts_makes_no_blocks(spark, monkeypatch):
    """A shingle that the first order does not know as frequent stands in the prefixes of unlike classes: further orders part them."""
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    monkeypatch.setattr(jaccard, "FEW", 16)
    rest, made = [], jaccard._verified_blocks
    monkeypatch.setattr(jaccard, "_verified_blocks", lambda hot, *more: rest.append(hot.count()) or made(hot, *more))
    rows = [(i, "all rights reserved here " + " ".join(f"t{i}_{j}" for j in range(12))) for i in range(1500)] + [(5000, "all rights reserved here " + " ".join(f"t7_{j}" for j in range(12)))]
    got = {r.id: r.component_id for r in jaccard.jaccard_groups(odd(spark, rows), k=3, num=90).collect()}
    assert got == {i: i for i in range(1500)} | {5000: 7} and rest == [0]


def test_classes_of_one_number_take_another_seed(spark, monkeypatch):
    made = jaccard._class
    monkeypatch.setattr(jaccard, "_class", lambda s, seed=0: (5, made(s, seed)[1]) if not seed else made(s, seed))
    got = {r.id: r.component_id for r in jaccard.jaccard_groups(odd(spark, [(1, "a b c d"), (2, "e f g h"), (3, "a b c d")]), k=3).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_groups_of_odd_rows(spark):
    got = jaccard.jaccard_groups(odd(spark, ODD)).collect()
    by = lambda i: [(r.n_shingles, r.component_id) for r in got if r.id == i]
    assert by(1) == [(0, 1)] and by(3) == [(0, 3)] and by(4) == [(1, 4)] and by(5) == [(1, 5), (1, 5)] and by(6) == [(977, 6)]
    assert sorted(by(None), key=str) == [(0, None), (1, 5)]
    assert jaccard.jaccard_groups(odd(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(5, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]))
def test_prefix_filters_lose_no_pair(common, left, right, seed, threshold):
    num, den = threshold
    values = wordhash.mix(np.arange(common + left + right, dtype=np.uint64) + np.uint64(seed))
    a, b = np.sort(values[: common + left]), np.sort(np.concatenate((values[:common], values[common + left :])))
    if den * common < num * (common + left + right):
        return
    least = -(-num * (len(a) + len(b)) // (num + den))
    x, y = (jaccard._late_prefixes(s, num, den).reshape(jaccard.ORDERS - 1, -1) for s in (a, b))
    assert all(jaccard._share(p, q, len(a) - least, len(b) - least) for p, q in zip(x, y, strict=True))
    p, q = (jaccard._prefix(s, jaccard._hashed(s, 0), jaccard._prefix_size(len(s), num, den)) for s in (a, b))
    assert len(np.intersect1d(p, q))


# 6. Packing.

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check_packed(rows, texts, size=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for i, t in texts:
        want[i, hashlib.md5(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()).hexdigest()] += 1
    pieces = {}
    for r in rows:
        assert r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append(r)
    if len(texts) == len({i for i, _ in texts}):
        for i, own in pieces.items():
            body = b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))
            assert (i, hashlib.md5(body).hexdigest()) in want and len(body) == 4 * own[0].doc_tokens
            assert [r.start for r in sorted(own, key=lambda r: r.start)] == list(itertools.accumulate([r.length for r in sorted(own, key=lambda r: r.start)][:-1], initial=0))
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in rows) / size / max(1, len(sequences))


def test_packing(spark, docs, texts):
    rows = pack.pack(docs.repartition(3), VOCABULARY, keep_ids=True).collect()
    assert check_packed(rows, list(texts.items())) > 0.95
    assert len({r.doc_id for r in rows}) == len(texts)


def test_packing_odd_rows(spark, docs):
    rows = pack.pack(odd(spark, [*ODD, (9, "<|endoftext|> is text"), (10, "a" * 5000), (11, " " * 3000)]), VOCABULARY, keep_ids=True).collect()
    check_packed([r for r in rows], [*ODD, (9, "<|endoftext|> is text"), (10, "a" * 5000), (11, " " * 3000)])
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert pack.pack(odd(spark, []), VOCABULARY).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.integers(1, 8))
def test_windows_hold_every_piece_once(lengths, most):
    w, out = pack.Windows(100, most), []
    for i, n in enumerate(lengths):
        out += w.put((i, n), n)
        assert len(w.free) <= most
    while w.free:
        out += w.emit(0)
    assert sorted(p[0] for p, _, _ in out) == list(range(len(lengths)))
    used = Counter()
    for (_, n), win, _ in out:
        used[win] += n
    assert max(used.values(), default=0) <= 100


def test_ids_are_those_of_the_vocabulary(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    encode = pack.encoder(VOCABULARY)
    for t in [*texts.values(), "  two  spaces\n\n\tand tabs ", "don't we'll I'VE", "x" * 1200, "日本語 텍스트 😀😀", "a b c\x1cd\x85e", "<|endoftext|>"]:
        assert encode(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert 50256 in np.frombuffer(encode("a <|endoftext|> b"), "<u4")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=150), st.integers(1, 6))
def test_placement_is_best_fit_and_the_fullest_goes(lengths, most):
    """Against a plain simulation: windows as (free, number), searched in full for every piece."""
    w, got = pack.Windows(100, most), []
    plain, want, made = {}, [], 0
    for i, n in enumerate(lengths):
        got += [(p[0], win, off) for p, win, off in w.put((i, n), n)]
        fits = [(100 - sum(x for _, x, _ in own), win) for win, own in plain.items() if 100 - sum(x for _, x, _ in own) >= n]
        if fits:
            win = min(fits)[1]
        else:
            if len(plain) >= most:
                full = min(plain, key=lambda win: (100 - sum(x for _, x, _ in plain[win]), win))
                want += [(p, full, off) for p, _, off in plain.pop(full)]
            win, made = made, made + 1
            plain[win] = []
        plain[win].append((i, n, sum(x for _, x, _ in plain[win])))
        if sum(x for _, x, _ in plain[win]) == 100:
            want += [(p, win, off) for p, _, off in plain.pop(win)]
    assert got == want


# 7. Language model.


def test_scores(spark, docs, texts):
    rows = {r.id: r for r in hmm.score_texts(docs, rounds=2).collect()}
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in train for w in words[i])
    counts[None] = len(train)
    total, distinct = sum(counts.values()), len(counts)
    for i, w in words.items():
        tokens = [*w, None]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in set(train), len(tokens), sum(counts[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_meet_their_counts(spark, docs, monkeypatch):
    want = {r.id: r.base_score for r in hmm.score_texts(docs, rounds=1).collect()}
    monkeypatch.setattr(hmm, "FREQUENT", 50)
    monkeypatch.setattr(hmm, "SYMBOLS", 20)
    assert {r.id: pytest.approx(r.base_score, rel=1e-9) for r in hmm.score_texts(docs, rounds=1).collect()} == want


def _model(seed, size=30):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis=None: x / x.sum(axis, keepdims=axis is not None)
    return hmm.Model(norm(rng.random(hmm.STATES)), norm(rng.random((hmm.STATES, hmm.STATES)), 1), norm(rng.random((size, hmm.STATES)), 0))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=6), st.integers(0, 99), st.integers(3, 20))
def test_forward_recursion_is_exact(lengths, seed, segment):
    model, rng = _model(seed), np.random.default_rng(seed)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    flat = rng.integers(0, 30, bounds[-1])
    got = hmm.log10_likelihood(flat, bounds, model, segment)
    for i, n in enumerate(lengths):
        seq = flat[bounds[i] : bounds[i + 1]]
        a, log = model.first * model.emit[seq[0]], 0.0
        for s in seq[1:]:
            log, a = log + math.log10(a.sum()), (a / a.sum()) @ model.step * model.emit[s]
        assert got[i] == pytest.approx(log + math.log10(a.sum()), rel=1e-9)


def test_expected_counts_are_those_of_all_paths(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    model, seq = _model(5, 4), np.array([0, 3, 1, 1])
    sums = np.zeros((4 + 2 + 1, 2))
    hmm.expected(seq, np.array([0, 4]), model, sums)
    cut = np.zeros_like(sums)
    hmm.expected(seq, np.array([0, 4]), model, cut, segment=2)  # transitions between segments count too
    assert np.allclose(cut, sums)
    want, total = np.zeros_like(sums), 0.0
    for path in itertools.product(range(2), repeat=4):
        p = model.first[path[0]] * math.prod(model.emit[s, k] for s, k in zip(seq, path, strict=True)) * math.prod(model.step[a, b] for a, b in zip(path, path[1:]))
        total += p
        for s, k in zip(seq, path, strict=True):
            want[s, k] += p
        for a, b in zip(path, path[1:]):
            want[4 + a, b] += p
        want[-1, path[0]] += p
    assert np.allclose(sums, want / total)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=7), st.integers(0, 99), st.integers(1, 25), st.integers(5, 100))
def test_counts_do_not_depend_on_segments(lengths, seed, segment, group):
    model, rng = _model(seed), np.random.default_rng(seed)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    flat = rng.integers(0, 30, bounds[-1])
    whole, cut = np.zeros((30 + hmm.STATES + 1, hmm.STATES)), np.zeros((30 + hmm.STATES + 1, hmm.STATES))
    hmm.expected(flat, bounds, model, whole)
    old, hmm.GROUP = hmm.GROUP, group
    try:
        hmm.expected(flat, bounds, model, cut, segment)
    finally:
        hmm.GROUP = old
    assert np.allclose(whole, cut) and whole[:30].sum() == pytest.approx(bounds[-1]) and whole[30:-1].sum() == pytest.approx(bounds[-1] - len(lengths))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 15, 40) + 15 * (i % 2) for i in range(60)]
    flat, bounds = np.concatenate(seqs), np.arange(0, 2401, 40)
    share = np.bincount(flat, minlength=30) / len(flat)
    lex = hmm.Lexicon(None, None, None, 30 - hmm.TAILS - 1, None, share, 0, 0, 0)
    model, last = _model(1), -np.inf
    monkey = hmm.PRIOR
    hmm.PRIOR = 0.001
    for _ in range(5):
        now = hmm.log10_likelihood(flat, bounds, model).sum()
        assert now > last - 1
        last = now
        sums = np.zeros((30 + hmm.STATES + 1, hmm.STATES))
        hmm.expected(flat, bounds, model, sums)
        model = hmm.Model.of(sums, lex)
    hmm.PRIOR = monkey


def test_scores_of_odd_rows(spark):
    rows = hmm.score_texts(odd(spark, ODD), rounds=1).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.id in (1, 2, 3)} == {1} and len({r.score for r in rows if r.id == 5}) == 1
    assert hmm.score_texts(odd(spark, [])).collect() == []


# 8. Chat formatting.


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "|>", "[", "INST]", "<", "s>", "a", "\n", "é", "<|image:0|>", "turn"]), max_size=10).map("".join))
def test_escaping_is_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_parts(spark):
    part = lambda kind, **more: {"type": kind} | more
    rows = [(1, 0, "user", [part("text", text="See "), part("image", ref="a.png", width=56, height=30), part("audio", ref="b.wav", seconds=2.0)]), (1, 1, "assistant", [part("text", text="ok <|image:0|>")]), (1, 2, "user", [part("document", ref="c.pdf", pages=3), part("text", text=None)]), (None, 0, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    r = out[1]
    assert r.formatted.startswith("<|turn|>user<|text|>See <|image:0|><|audio:1|><|end|>")
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 3072)]
    assert all(r.formatted[a.at :].startswith(f"<|{a.kind}:{i}|>") for i, a in enumerate(r.attachments)) and r.attachment_tokens == 3126
    assert chat.read_back(r.formatted) == [("user", "See "), ("assistant", "ok <|image:0|>"), ("user", "")]
    assert [chat.unescape(r.formatted[x.start : x.end]) for x in r.loss] == ["ok <|image:0|>"]
    assert out[None].n_turns == 1 and chat.read_back(out[None].formatted) == [("", "")]


def test_no_part_stops_the_job(spark):
    """Random parts of any type and size against a plain flattening."""
    rng = np.random.default_rng(8)
    kinds, seconds, whole = ["text", "image", "audio", "document", "video", "other", "_place", None], [None, 0.0, -1.0, 2.5, math.nan, math.inf, 1e300], [None, 0, -5, 1, 57, 3_000_000, 2**31 - 1]
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows = [(i, t, pick(["user", "assistant", None]), [{"type": pick(kinds), "text": pick([None, "hi <|image:0|>", "<|unknown:0|>", "\\"]), "ref": f"r{j}", "width": pick(whole), "height": pick(whole), "seconds": pick(seconds), "pages": pick(whole)} for j in range(rng.integers(0, 4))]) for i in range(40) for t in range(2)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {chat.PARTS}")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for i in range(40):
        want, texts, loss = [], [], ""
        for _, _, role, parts in rows[2 * i : 2 * i + 2]:
            said = ""
            for p in parts:
                if p["type"] in ("text", None):
                    said += p["text"] or ""
                    continue
                tiles = lambda x: math.ceil(max(1 if not x else x, 0) / 28)
                heard = p["seconds"] or 0
                size = {"image": tiles(p["width"]) * tiles(p["height"]), "document": max(1 if p["pages"] is None else p["pages"], 0) * 1024, "audio": 0 if not math.isfinite(heard) or heard < 0 else min(math.ceil(heard * 25), 2**63 - 1)}
                want.append((p["type"] if p["type"] in size else "unknown", p["ref"], size.get(p["type"], 0)))
            texts.append((role or "", said))
            loss += said if role == "assistant" else ""
        r = out[i]
        assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == want and chat.read_back(r.formatted) == texts
        assert r.attachment_tokens == min(sum(x[2] for x in want), 2**63 - 1)
        assert all(r.formatted[a.at :].startswith(f"<|{a.kind}:{k}|>") for k, a in enumerate(r.attachments))
        assert "".join(chat.unescape(chat._PLACE.sub("", r.formatted[x.start : x.end])) for x in r.loss) == loss


def test_conversations(spark, sf):
    rows = {r.conv_id: r for r in queries.op8_chat_parts(spark, sf).collect()}
    said = "</s>[INST] ok [/INST]"
    turns = pd.concat([spark.read.parquet(f"{sf}/conversations.parquet").toPandas(), pd.DataFrame({"conv_id": -7, "turn": [0, 1], "role": ["user", "assistant"], "text": said})])
    assert len(rows) == turns.conv_id.nunique()
    for i, g in turns.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        loss = "".join(g.text[g.role == "assistant"])
        whole = "".join(f"{a}\n{b}\n" for a, b in zip(g.role, g.text, strict=True))
        assert (rows[i].n_turns, rows[i].turns_sha256, rows[i].loss_chars, rows[i].loss_sha256) == (len(g), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


# 9. Quality.


def test_isotonic_levels():
    assert quality.isotonic(np.array([0, 2, 2, 0, 2]), np.array([0, 1, 0, 0, 2])).tolist() == [0.25, 0.25, 0.25, 0.25, 1.0]
    assert quality.isotonic(np.zeros(3), np.zeros(3)).tolist() == [0.5] * 3


def test_statistics_are_per_text():
    texts = ["The THE 12 the", None, "", "a#b\na#b\nc", " x x x "]
    whole = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(whole, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]))
    f = dict(zip(quality.FEATURES, whole[0], strict=True))
    assert f["upper"] == 4 / 14 and f["digit"] == 2 / 14 and f["distinct"] == 0.5
    assert dict(zip(quality.FEATURES, whole[3], strict=True))["repeated_lines"] == pytest.approx(1 / 3)
    assert not whole[1].any() and not whole[2].any()


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y == 1 and z == 0]
    assert np.mean(pairs) > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    shuffled = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(0))
    assert {r.doc_id: pytest.approx(r.score) for r in quality.quality(shuffled, labels).collect()} == {i: r.score for i, r in rows.items()}


def test_fit_is_ridge_and_pooling(spark, docs, sf):
    """The model against normal equations in one place and pooling of adjacent violators by repeated passes."""
    rows = docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("text", F.col("quality").alias("y")).collect()
    x = np.concatenate([quality.statistics(pa.array([r.text])) for r in rows])
    y = np.array([r.y for r in rows], float)
    model = quality.fit(spark.createDataFrame([(row.tolist(), int(v)) for row, v in zip(x, y, strict=True)], "x array<double>, y int").repartition(3))
    deviation = x.std(0)
    z = quality.random_features(np.clip((x - x.mean(0)) / np.where(deviation > 1e-9, deviation, 1), -8, 8))
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]) / z.shape[1], z.T @ y)
    raw = z @ weights
    assert np.abs(model.raw(x) - raw).max() < 1e-4
    at = quality.bins(model.raw(x))
    groups = [[b, [b], y[at == b].tolist()] for b in np.unique(at)]
    falls = lambda: next((i for i in range(len(groups) - 1) if np.mean(groups[i][2]) >= np.mean(groups[i + 1][2])), None)
    while (i := falls()) is not None:
        groups[i : i + 2] = [[groups[i][0], groups[i][1] + groups[i + 1][1], groups[i][2] + groups[i + 1][2]]]
    level = {b: np.mean(v) for _, own, v in groups for b in own}
    assert model.score(x) == pytest.approx([level[b] for b in at])


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, None, None), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(odd(spark, []), labels).collect() == []
    assert {r.score for r in quality.quality(odd(spark, ODD), labels.where("false")).collect()} == {0.5}


# 10. Licenses.


def test_licenses_agree_with_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(license.oracle()).fetchall())
    got = sorted(tuple(r) for r in queries.op10_license_scan(spark, sf).collect())
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and [r[-1] for r in got] == pytest.approx([r[-1] for r in want])


def test_license_scan(spark):
    cases = [(1, "Mit   LICENSE; CC-BY and cc by.\nApache\nLicense"), (2, None), (3, ""), (4, "licensed under the Apache License, version 2.0"), (5, "permission is hereby granted, free of charge, to any person obtaining a copy of this Software and associated documentation files (the"), (6, "smit license"), (7, "émit license mit licenseé"), (7, "émit license mit licenseé"), (None, "MIT license"), (8, LONG)]
    rows = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in sorted(license.scan(odd(spark, cases)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))]
    assert rows[0] == (1, 9, 4, 0, 7, "apache,cc-by,mit", "apache,cc-by,mit", 1.0)
    assert rows[1] == (2, 0, 0, None, None, "", "", 0.0) and rows[2][1:] == rows[1][1:]
    assert rows[3][5:] == ("apache", "apache,apache-2.0", 1.0) and rows[4][5:] == ("", "mit-grant", 1.0)
    assert rows[5][2:] == (0, None, None, "", "", 0.0) and rows[6] == rows[7] == (7, 4, 0, None, None, "", "", 0.0)
    assert rows[9][:4] == (None, 2, 1, 0) and rows[8][:3] == (8, 30000, 0)
    assert license.scan(odd(spark, [])).collect() == []


def test_license_filters_lose_nothing(spark):
    """Every run of words of every text against every template, over all lines; with repeated rows and hot words."""
    rng = np.random.default_rng(4)
    words = "permission granted license free software under terms copy use source".split()
    templates = {f"t{i}": " ".join(rng.choice(words, rng.integers(2, 8), replace=False)) for i in range(12)} | {"none": ""}
    cases = [(i % 50, "\n".join(" ".join(rng.choice([*words, "other", "words"], rng.integers(0, 12))) for _ in range(4))) for i in range(60)]
    cases += cases[:5] + [(99, "free software " * 500)]
    got = {(r.doc_id, r.n_words, r.labels) for r in license.scan(odd(spark, cases), templates=templates, threshold=0.7).collect()}
    want = set()
    for i, text in cases:
        own, labels = text.split(), []
        for label, t in templates.items():
            block, distinct = math.ceil(license.SPREAD * len(t.split())), set(t.split())
            if distinct and any(len(distinct & set(own[at : at + block])) >= math.ceil(0.7 * len(distinct) - 1e-9) for at in range(len(own))):
                labels.append(label)
        want.add((i, len(own), ",".join(sorted(labels))))
    assert got == want


def test_wrapped_notices_are_found(spark):
    wrapped = {
        "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n",
        "bsd-3-clause": " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that",
        "isc": "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided",
        "gpl-notice": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
    }
    spread = "Permission is hereby\n" + "other words stand here\n" * 9 + "granted free of charge to any person obtaining a copy\n" + "and here\n" * 9 + "of this software and associated documentation files"
    rows = license.scan(odd(spark, enumerate([*wrapped.values(), spread]))).collect()
    got = {r.doc_id: (r.labels.split(","), r.score) for r in rows}
    assert all(label in got[i][0] and got[i][1] == 1.0 for i, label in enumerate(wrapped)) and got[4] == ([""], 0.0)
