"""Hidden Markov language model over whole texts, trained by Baum-Welch counts that are summed across partitions.

A latent state emits one symbol at a time. Frequent words are symbols of their own; other words share symbols by
their last bytes, and a word's probability inside its class is its smoothed share of the class, which no state
changes. So the model's tables have a fixed size, and the probability of a text is that of its symbols, by the
scaled forward recursion, times those shares. Word counts stay in a table; only the most frequent ones are sent to
every task, and the rest meet their words in a join.

Long texts are cut into segments of SEGMENT symbols that are worked on side by side. In scoring, a segment becomes a
matrix, which takes a state before it to the states at its end, and the matrices chain to the exact likelihood of the
whole. In training they also chain to what stands before and after each segment, so expected counts are those of whole
texts, transitions between segments included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, most_counted, ready, written
from .wordhash import chunks, hashes, spans

STATES = 8
SYMBOLS = 8192  # words that are symbols of their own
TAILS = 1024  # classes of the other words
FREQUENT = 1 << 18  # words whose counts every task holds, at most
ROUNDS = 5
SEGMENT = 4096
GROUP = 1 << 20  # symbols that are worked on side by side
PRIOR = 50.0  # weight of the symbols' overall shares in every state
_CASE = np.arange(256, dtype=np.uint64)
_CASE[65:91] += 32


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def tails(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each word by its last three bytes."""
    code = np.zeros(len(ends), np.uint64)
    for back in (1, 2, 3):
        there = ends - back >= starts
        code = code * np.uint64(257) + np.where(there, _CASE[data[np.maximum(ends - back, 0)]] + np.uint64(1), np.uint64(0))
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64) % TAILS


def _words(col):
    for a, b, data, off in chunks(col):
        s, e, n = spans(data, off)
        yield a, b, hashes(data, s, e), tails(data, s, e), n


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, tail, n) of all texts; each batch sends a word once."""

    def count(batches):
        for batch in batches:
            found = [(h, t) for _, _, h, t, _ in _words(batch.column(0))]
            if found:
                word, first, n = np.unique(np.concatenate([h for h, _ in found]), return_index=True, return_counts=True)
                tail = np.concatenate([t for _, t in found])[first]
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tail.astype(np.int16)), pa.array(n.astype(np.int64))], names=["word", "tail", "n"])

    rows = docs.select(text).mapInArrow(count, "word long, tail short, n long")
    return rows.groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Counts of training tokens. words are sorted; symbol is a word's own symbol or -1."""

    words: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray
    symbols: int
    class_log: np.ndarray  # log10 of a class's smoothed size
    share: np.ndarray  # overall share of each symbol
    tokens: int
    distinct: int
    texts: int

    @property
    def size(self) -> int:
        return self.symbols + TAILS + 1

    @property
    def end(self) -> int:
        return self.symbols + TAILS


def lexicon(counts: DataFrame, texts: int) -> Lexicon:
    tokens, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens = tokens or 0
    common = sorted(most_counted(counts, "word", "n", FREQUENT, "tail"), key=lambda r: (-r[1], r[0]))
    words = np.array([r[0] for r in common], np.int64).view(np.uint64)
    n = np.array([r[1] for r in common], np.int64)
    tail = np.array([r[2] for r in common], np.int64)
    own = min(len(words), SYMBOLS)
    size, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for t, total, some in counts.groupBy("tail").agg(F.sum("n"), F.count(F.lit(1))).collect():  # TAILS rows at most
        size[t], kinds[t] = total, some
    size -= np.bincount(tail[:own], n[:own], TAILS)
    kinds -= np.bincount(tail[:own], minlength=TAILS)
    weight = np.concatenate((n[:own], size, [texts])) + 0.5
    symbol = np.where(np.arange(len(words)) < own, np.arange(len(words)), -1)
    order = np.argsort(words)
    return Lexicon(words[order], n[order], symbol[order], own, np.log10(size + 0.5 * (kinds + 1)), weight / weight.sum(), tokens + texts, distinct + (texts > 0), texts)


@dataclass
class Model:
    first: np.ndarray  # of the states of a text's first symbol
    step: np.ndarray
    emit: np.ndarray  # a row for each symbol

    @staticmethod
    def start(lex: Lexicon) -> Model:
        rng = np.random.default_rng(7)
        emit = lex.share[:, None] * np.exp(0.7 * rng.standard_normal((lex.size, STATES)))
        step = np.full((STATES, STATES), 0.05 / (STATES - 1))
        np.fill_diagonal(step, 0.95)
        even = np.full(STATES, 1 / STATES)
        return Model(even, step, emit / emit.sum(0))

    @staticmethod
    def of(sums: np.ndarray, lex: Lexicon) -> Model:
        """From summed counts: a row for each symbol, then for each state (its successors), then firsts."""
        emit = sums[: lex.size] + PRIOR * lex.share[:, None]
        step = sums[lex.size : lex.size + STATES] + 1
        first = sums[-1] + 1
        return Model(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _packed(flat: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Segments by falling length: their order, how many reach each step, and where a step's symbols stand in flat."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    return order, start, alive


def _pieces(bounds: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and length of the segments of all sequences, in order."""
    size = np.diff(bounds)
    many = -(-size // segment)
    text = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[:-1][text] + nth * segment
    return text, start, np.minimum(segment, bounds[1:][text] - start)


def _passed(flat: np.ndarray, start: np.ndarray, length: np.ndarray, into: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """State distributions at the end of segments that begin with the distributions `into`, and log10 probabilities."""
    order, first, alive = _packed(flat, start, length)
    a = into[order] * model.emit[flat[first]]
    logs, last = np.zeros(len(order)), np.zeros((len(order), STATES))
    for t in range(len(alive)):
        if t:
            last[alive[t] : len(a)] = a[alive[t] :]
            a = (a[: alive[t]] @ model.step) * model.emit[flat[first[: alive[t]] + t]]
        scale = a.sum(1)
        a = a / scale[:, None]
        logs[: len(a)] += np.log10(scale)
    last[: len(a)] = a
    ends, sizes = np.empty_like(last), np.empty_like(logs)
    ends[order], sizes[order] = last, logs
    return ends, sizes


def _matrices(flat: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, model: Model) -> tuple[list, list]:
    """For each segment the distributions at its end and their log10 weights: one row for a segment that opens a text,
    else one for each state before it."""
    opens = np.concatenate(([True], text[1:] != text[:-1]))
    rows = np.where(opens, 1, STATES)
    piece = np.repeat(np.arange(len(text)), rows)
    state = np.arange(len(piece)) - np.repeat(np.cumsum(rows) - rows, rows)
    into = np.where(opens[piece][:, None], model.first, model.step[state])
    ends, logs = _passed(flat, start[piece], length[piece], into, model)
    cuts = np.cumsum(rows)[:-1]
    return np.split(ends, cuts), np.split(logs, cuts)


def _around(flat: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each segment: the distribution of the state before it (of no use where it opens a text), and the weight of
    every state at its end for what follows in the text."""
    before, after = np.zeros((len(text), STATES)), np.ones((len(text), STATES))
    several = np.flatnonzero(np.bincount(text)[text] > 1)
    if not len(several):
        return before, after
    ends, logs = _matrices(flat, text[several], start[several], length[several], model)
    weights = [10.0 ** (x - x.max()) for x in logs]
    for j, i in enumerate(several.tolist()):
        if j and text[several[j - 1]] == text[i]:
            p = several[j - 1]
            now = ends[j - 1][0] if len(ends[j - 1]) == 1 else (before[p] * weights[j - 1]) @ ends[j - 1]
            before[i] = now / now.sum()
    for j in range(len(several) - 2, -1, -1):
        if text[several[j]] == text[several[j + 1]]:
            now = weights[j + 1] * (ends[j + 1] @ after[several[j + 1]])
            after[several[j]] = now / now.max()
    return before, after


def expected(flat: np.ndarray, bounds: np.ndarray, model: Model, sums: np.ndarray, segment: int = SEGMENT) -> None:
    """Add the expected counts of the whole sequences flat[bounds[i]:bounds[i + 1]] (none empty) to sums."""
    text, start, length = _pieces(bounds, segment)
    before, after = _around(flat, text, start, length, model)
    opens = np.concatenate(([True], text[1:] != text[:-1]))
    rank = np.argsort(-length, kind="stable")
    group = (np.cumsum(length[rank]) - 1) // GROUP  # segments of similar length go together
    for own in np.split(rank, np.flatnonzero(np.diff(group)) + 1):
        _counted(flat, start[own], length[own], opens[own], before[own], after[own], model, sums)


def _counted(flat, start, length, opens, before, after, model: Model, sums: np.ndarray) -> None:
    """Add the expected counts of segments, given what stands before and after them."""
    order, start, alive = _packed(flat, start, length)
    opens, before, after = opens[order], before[order], after[order]
    e = model.emit[flat[start]]
    a = np.where(opens[:, None], model.first, before @ model.step) * e
    scale = a.sum(1)
    a /= scale[:, None]
    alphas, emits, scales = [a], [e], [scale]
    for t in range(1, len(alive)):
        e = model.emit[flat[start[: alive[t]] + t]]
        a = (a[: alive[t]] @ model.step) * e
        scale = a.sum(1)
        a /= scale[:, None]
        alphas.append(a)
        emits.append(e)
        scales.append(scale)
    ending = lambda t, n: after[n : alive[t]] / (alphas[t][n:] * after[n : alive[t]]).sum(1)[:, None]
    b = ending(len(alive) - 1, 0)
    moves = np.zeros((STATES, STATES))
    gammas = [None] * len(alive)
    for t in range(len(alive) - 1, -1, -1):
        gammas[t] = alphas[t] * b
        w = emits[t] * b / scales[t][:, None]
        if t:
            moves += alphas[t - 1][: alive[t]].T @ w
            b = np.concatenate((w @ model.step.T, ending(t - 1, alive[t])))
        else:
            moves += before[~opens].T @ w[~opens]
    where = np.concatenate([start[: alive[t]] + t for t in range(len(alive))])
    gamma = np.concatenate(gammas)
    size = len(sums) - STATES - 1
    for k in range(STATES):
        sums[:size, k] += np.bincount(flat[where], gamma[:, k], size)
    sums[size : size + STATES] += moves * model.step
    sums[-1] += gammas[0][opens].sum(0)


def log10_likelihood(flat: np.ndarray, bounds: np.ndarray, model: Model, segment: int = 1024) -> np.ndarray:
    """log10 probability of each whole sequence flat[bounds[i]:bounds[i + 1]] (none empty)."""
    text, start, length = _pieces(bounds, segment)
    ends, logs = _matrices(flat, text, start, length, model)
    out, now = np.zeros(len(bounds) - 1), None
    for i, own, size in zip(text.tolist(), ends, logs, strict=True):
        if len(own) == 1:
            now, out[i] = own[0], size[0]
            continue
        now = (now * 10.0 ** (size - size.max())) @ own
        out[i] += size.max() + math.log10(now.sum())
        now = now / now.sum()
    return out


def _encoded(docs: DataFrame, id_col: str, text: str, shared) -> DataFrame:
    """Each text's symbols, sums over the words whose counts tasks hold, and its other words with their number."""
    schema = "id long, held_out boolean, uid long, tokens long, known long, common double, inside double, rest long, rare array<long>, times array<int>, symbols array<short>"

    def encode(batches):
        lex, uid = shared.value, TaskContext.get().partitionId() << 33
        log_count = np.log10(lex.counts + 0.5)
        for batch in batches:
            out = [[] for _ in range(9)]
            for a, b, h, tail, n in _words(batch.column(2)):
                at = np.minimum(np.searchsorted(lex.words, h), max(len(lex.words) - 1, 0))
                held = lex.words[at] == h if len(lex.words) else np.zeros(len(h), bool)
                symbol = np.where(held, lex.symbol[at], -1) if len(lex.words) else np.full(len(h), -1)
                classed = symbol < 0
                sym = np.where(classed, lex.symbols + tail, symbol).astype(np.int16)
                value = np.where(held, log_count[at] if len(lex.words) else 0.0, 0.0)
                inside = np.where(classed, value - lex.class_log[tail], 0.0)
                sums = [np.concatenate(([0], np.cumsum(v))) for v in (held, value, inside)]
                per = [(s[n[1:]] - s[n[:-1]]) for s in sums]
                for i in range(b - a):
                    lo, hi = n[i], n[i + 1]
                    rare, times = np.unique(h[lo:hi][~held[lo:hi]], return_counts=True)
                    row = (uid, hi - lo + 1, int(per[0][i]), float(per[1][i]), float(per[2][i]), int(times.sum()), rare.view(np.int64), times.astype(np.int32), np.append(sym[lo:hi], np.int16(lex.end)))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    uid += 1
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int16())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text")).mapInArrow(encode, schema)


def _sequences(col):
    return col.values.to_numpy(zero_copy_only=False).astype(np.int64), col.offsets.to_numpy().astype(np.int64)


def _round(texts: DataFrame, lex: Lexicon, model: Model) -> Model:
    height = lex.size + STATES + 1
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def expect(batches):
        model, sums = shared.value, np.zeros((height, STATES))
        for batch in batches:
            flat, off = _sequences(batch.column(0))
            if len(off) > 1:
                expected(flat, off, model, sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(height)), *(pa.array(sums[:, k]) for k in range(STATES))], names=["at", *(f"k{k}" for k in range(STATES))])

    parts = texts.select("symbols").mapInArrow(expect, "at long, " + ", ".join(f"k{k} double" for k in range(STATES)))
    sums = np.zeros((height, STATES))
    for at, *row in parts.groupBy("at").agg(*[F.sum(f"k{k}") for k in range(STATES)]).collect():  # one row for each symbol
        sums[at] = row
    shared.destroy()
    return Model.of(sums, lex)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each text.

    A text is its words (A-Z counts as a-z) and one end. The model learns from texts whose crc32 of the id as text
    has a remainder other than 1 by 5, and from those with a null id. base_score is the log10 probability under
    smoothed word counts, score that under the hidden Markov model. Null and empty texts are one end. Equal and
    repeated rows are learnt from and scored each. An empty table gives no rows; with nothing to learn from, every
    word is unknown and the model is its prior.
    """
    spark = docs.sparkSession
    ready(spark)
    training = docs.where(~held_out(F.col(id_col)))
    counts = written(word_counts(training, text), "words")
    lex = lexicon(counts, training.count())
    shared = spark.sparkContext.broadcast(lex)  # FREQUENT words at most
    texts = written(_encoded(docs, id_col, text, shared), "texts")
    model = Model.start(lex)
    for _ in range(rounds):
        model = _round(texts.where("not held_out"), lex, model)

    rare = texts.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    met = rare.join(counts.select("word", "n"), "word")
    more = met.groupBy("uid").agg(F.sum("times").alias("met"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - math.log10(0.5))).alias("gain"))
    more = written(more, "rare")
    dropped(counts)
    trained = spark.sparkContext.broadcast(model)

    def forward(batches):
        model = trained.value
        for batch in batches:
            flat, off = _sequences(batch.column(0))
            parts, at, n = [], 0, len(off) - 1
            while at < n:
                to = max(at + 1, int(np.searchsorted(off, off[at] + 300_000, "right")) - 1)
                parts.append(log10_likelihood(flat, off[at : to + 1], model))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(1, 8)] + [pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["id", "held_out", "uid", "tokens", "known", "common", "inside"] + ["path"])

    rest = (F.col("rest") * math.log10(0.5)).alias("rest")
    out = texts.select("symbols", "id", "held_out", "uid", "tokens", "known", (F.col("common") + rest).alias("common"), (F.col("inside") + rest).alias("inside")).mapInArrow(forward, "id long, held_out boolean, uid long, tokens long, known long, common double, inside double, path double")
    out = out.join(more, "uid", "left")
    gain, end = F.coalesce("gain", F.lit(0.0)), math.log10(lex.texts + 0.5)
    norm = math.log10(lex.tokens + 0.5 * (lex.distinct + 1))
    return out.select(
        "id",
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("met", F.lit(0)) + int(lex.texts > 0)).cast("long").alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("common") + gain + end - F.col("tokens") * norm).alias("base_score"),
        (F.col("path") + F.col("inside") + gain).alias("score"),
    )
