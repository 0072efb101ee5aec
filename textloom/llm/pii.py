"""Personal data: fixed patterns, extended by a skip-chain conditional random field over each document.

The patterns give the base spans. The field's nodes are the units of a text that may be personal data: numeric runs,
words with a digit or an @, and further mentions of an address's local part. Chain edges join neighbouring units, skip
edges join each unit to the one before it with the same key (the same last digits, address or local part), however
far away. Units under base spans are observed; loopy belief propagation labels the others, and a unit that is likely
enough to have a label becomes a span. Potentials are fitted piecewise, as smoothed log ratios of counts over all
texts, whose labels are the base spans and the units that share a key with one.

A word without digit, @ or such a mention is always observed as no personal data, so it needs no node.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
LIKELY = 0.6
STEPS = 10  # sweeps that every text may have, besides two for each mention of its most repeated key
SETTLED = 1e-4  # changes of a message below this are not passed on
NEAR = 40  # characters between neighbouring units
# The patterns, with guards that change no match but keep long runs linear.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_UNIT = re.compile(r"(?<!\S)(?=\S*[0-9@])(?=\S*[A-Za-z@])\S+|(?<![0-9A-Za-z])\+?\(?[0-9][0-9 ().-]*+")
_EDGE = " .,;:!?()[]{}<>\"'"


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last if found else 0))


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of the kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _key(body: str) -> str:
    if "@" in body:
        return "e" + body.partition("@")[0].lower()
    digits = "".join(c for c in body if "0" <= c <= "9")
    if body.count(".") == 3 and _IP.fullmatch(body):
        return "i" + body
    return "d" + digits[-7:] if len(digits) >= 7 else ""


def _shape(body: str) -> int:
    digits = "".join(c for c in body if "0" <= c <= "9")
    size = int(np.searchsorted([1, 3, 4, 5, 7, 9, 13, 20], len(digits), "right"))
    dots = min(body.count("."), 4)
    flags = (any(c.isalpha() for c in body)) + 2 * ("@" in body) + 4 * ("-" in body or "(" in body or " " in body) + 8 * body.startswith("+")
    flags += 16 * (13 <= len(digits) <= 19 and luhn(digits))
    return (size * 5 + dots) * 32 + flags


SHAPES = 9 * 5 * 32


class Graph:
    """The units of many texts, with their edges."""

    def __init__(self):
        self.text, self.start, self.end, self.shape, self.label, self.closed = [], [], [], [], [], []
        self.sweeps: list[int] = []
        self.edges: tuple[list, list] = ([], [])  # chain, skip

    def add(self, row: int, text: str, base: list[tuple[int, int, int]]) -> None:
        spans = [(m.start(), m.end()) for m in _UNIT.finditer(text)]
        for kind, a, b in base:
            local = text[a:b].partition("@")[0]
            if kind == 0 and len(local) >= 4:
                spans += [(m.start(), m.end()) for m in re.finditer(r"(?<![\w@])" + re.escape(local) + r"(?![\w@])", text)]
        spans = sorted(set(spans))
        covered = sorted((a, b, k + 1) for k, a, b in base)
        first, seen, prev, i, far = len(self.text), {}, None, 0, 0
        known = {"e" + text[a:b].partition("@")[0].lower() for k, a, b in base if k == 0}
        for a, b in spans:
            while a < b and text[a] in _EDGE and text[a] != "(":
                a += 1
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            if a >= b or a < far:
                continue
            far = b
            while i < len(covered) and covered[i][1] <= a:
                i += 1
            label = next((k for s, e, k in covered[i : i + 4] if s < b and a < e), 0)
            body, node = text[a:b], len(self.text)
            key = "e" + body.lower() if "e" + body.lower() in known else _key(body)
            for store, value in ((self.text, row), (self.start, a), (self.end, b), (self.shape, _shape(body)), (self.label, label)):
                store.append(value)
            if prev is not None and a - self.end[prev] <= NEAR:
                self.edges[0].append((prev, node))
            prev = node
            if key:
                if key in seen:
                    self.edges[1].append((seen[key][-1], node))
                seen.setdefault(key, []).append(node)
        own = list(self.label[first:])
        for nodes in seen.values():
            kind = next((self.label[n] for n in nodes if self.label[n]), 0)
            for n in nodes:
                own[n - first] = own[n - first] or kind
        self.closed += own
        self.sweeps += [STEPS + 2 * max(map(len, seen.values()), default=0)] * len(own)


def _texts(col):
    """(row, text) of the texts that have a digit or an @."""
    mask = pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False)
    at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
    return zip(at.tolist(), col.take(pa.array(at)).to_pylist(), strict=True)


def fit(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Log potentials: (SHAPES, LABELS) of the units, (2, LABELS, LABELS) of chain and skip edges."""

    def count(batches):
        unary, pairs = np.zeros((SHAPES, LABELS), np.int64), np.zeros((2, LABELS, LABELS), np.int64)
        for batch in batches:
            g = Graph()
            for row, body in _texts(batch.column(0)):
                g.add(row, body, base_spans(body))
            label = np.array(g.closed, np.int64)
            np.add.at(unary, (np.array(g.shape, np.int64), label), 1)
            for kind in range(2):
                if g.edges[kind]:
                    a, b = np.array(g.edges[kind]).T
                    np.add.at(pairs[kind], (label[a], label[b]), 1)
        flat = np.concatenate((unary.ravel(), pairs.ravel()))
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["at", "n"])

    flat = np.zeros((SHAPES + 2 * LABELS) * LABELS)
    for at, n in docs.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # a fixed number of cells
        flat[at] = n
    unary, pairs = flat[: SHAPES * LABELS].reshape(SHAPES, LABELS), flat[SHAPES * LABELS :].reshape(2, LABELS, LABELS)
    prior = np.full(LABELS, 0.02)
    prior[0] = 1 - 0.02 * len(KINDS)
    unary = np.log((unary + 4 * prior) / (unary + 4 * prior).sum(1, keepdims=True))
    # Few counts: units that share a key agree, neighbours are independent.
    joint = pairs + np.stack((np.full((LABELS, LABELS), 1.0), 20 * np.eye(LABELS) + 0.05))
    joint = joint + joint.transpose(0, 2, 1)
    joint /= joint.sum((1, 2), keepdims=True)
    side = joint.sum(2)
    ratio = np.log(joint / (side[:, :, None] * side[:, None, :]))
    return unary, np.clip(ratio, [[[-2.0]], [[-8.0]]], [[[2.0]], [[8.0]]])


def infer(g: Graph, unary: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Marginals of all units by loopy belief propagation, swept until it settles; observed units keep their label."""
    own = unary[np.array(g.shape, np.int64)].copy()
    label = np.array(g.label, np.int64)
    seen = np.flatnonzero(label)
    own[seen] = -50.0
    own[seen, label[seen]] = 0.0
    ends = np.array(g.edges[0] + g.edges[1], np.int64).reshape(-1, 2)
    kind = np.repeat([0, 1], [len(g.edges[0]), len(g.edges[1])])
    src, dst = np.concatenate((ends[:, 0], ends[:, 1])), np.concatenate((ends[:, 1], ends[:, 0]))
    psi = np.concatenate((pairs[kind], pairs[kind].transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(ends)) + len(ends), np.arange(len(ends))))
    message = np.zeros((len(src), LABELS))
    belief = own.copy()
    # Only what a unit whose belief has changed says is said again, so a long chain costs its length, not its square.
    order = np.argsort(src, kind="stable")
    out = np.searchsorted(src[order], np.arange(len(own) + 1))
    limit = np.array(g.sweeps, np.int64)
    edges, sweep = np.arange(len(src)), 0
    while len(edges):
        into = (belief[src[edges]] - message[back[edges]])[:, :, None] + psi[edges]
        top = into.max(1)
        new = np.log(np.exp(into - top[:, None]).sum(1)) + top
        new -= new.max(1, keepdims=True)
        change = new - message[edges]
        message[edges] = new
        np.add.at(belief, dst[edges], change)
        sweep += 1
        nodes = np.unique(dst[edges[np.abs(change).max(1) >= SETTLED]])
        nodes = nodes[limit[nodes] > sweep]
        count = out[nodes + 1] - out[nodes]
        edges = order[np.repeat(out[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    belief = np.exp(belief - belief.max(1, keepdims=True))
    return belief / belief.sum(1, keepdims=True)


def find(col, unary: np.ndarray, pairs: np.ndarray):
    """For each text of an Arrow column: (base spans, all spans), by kind and start."""
    out: list[tuple[list, list]] = [([], [])] * len(col)
    g, bases, bodies = Graph(), {}, {}
    for row, body in _texts(col):
        bodies[row], bases[row] = body, base_spans(body)
        g.add(row, body, bases[row])
    more: dict[int, list] = {}
    if g.text:
        belief = infer(g, unary, pairs)
        best = belief.argmax(1)
        for n in np.flatnonzero((best > 0) & (np.array(g.label) == 0) & (belief.max(1) >= LIKELY)).tolist():
            more.setdefault(g.text[n], []).append((int(best[n]) - 1, g.start[n], g.end[n]))
    for row, base in bases.items():
        out[row] = (base, sorted(base + more.get(row, [])))
    return out


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each text.

    Counts and hash are those of the base spans, spans lists all. Null and empty texts have none; equal and repeated
    rows are judged each, and alike; null ids stay; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    unary, pairs = fit(docs, text)
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches):
        for batch in batches:
            found = find(batch.column(1), unary, pairs)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            hashed = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]
            spans = [said(all_) for _, all_ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashed, pa.string()), pa.array(spans, pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(read, f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; overlapping spans go as one, under the first kind."""
    ready(docs.sparkSession)
    unary, pairs = fit(docs, text)
    place = docs.columns.index(text)

    def mask(batches):
        for batch in batches:
            bodies = batch.column(place).to_pylist()
            for row, (_, spans) in enumerate(find(batch.column(place), unary, pairs)):
                if spans:
                    out, at = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b in spans):
                        if a >= at:
                            out += [bodies[row][at:a], f"[{KINDS[k].upper()}]"]
                        at = max(at, b)
                    bodies[row] = "".join([*out, bodies[row][at:]])
            cols = [pa.array(bodies, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)
