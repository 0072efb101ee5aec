"""Cutting texts: passages by words, overlapping windows, paragraphs, sentences; merging and choosing spans."""

from __future__ import annotations

import functools
import re
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectorised import vectorised

LEAST, MOST, CHUNK, TAIL = 60, 260, 180, 30  # words
_WORD = re.compile(r"[^ \t\r\n\xa0]+")
SPANS = "array<struct<start: int, end: int, text: string>>"


def _portions(words: int) -> list[int]:
    """Word counts into which a line goes: whole up to MOST, else pieces of CHUNK until no more than MOST are left."""
    pieces = -(-max(words - MOST, 0) // CHUNK)
    return [CHUNK] * pieces + [words - pieces * CHUNK]


def cut_passages(text: str) -> list[tuple[int, int]]:
    """Passages of a text as (start, end). A passage takes line after line until it has LEAST words, and never more than
    MOST; pieces of a longer line are passages of their own. A rest under TAIL words at the end of the text goes to the
    passage before it if MOST allows."""
    places = [[m.span() for m in _WORD.finditer(line)] for line in text.split("\n")]
    base = list(accumulate((len(line) + 1 for line in text.split("\n")), initial=0))
    spans = [(at + a, at + b) for at, line in zip(base, places, strict=False) for a, b in line]
    sizes: list[int] = []  # words of the passages so far
    growing = False  # whether the last one takes more lines
    for line in filter(None, places):
        portions = _portions(len(line))
        if growing and len(portions) == 1 and sizes[-1] + portions[0] <= MOST:
            sizes[-1] += portions[0]
        else:
            sizes += portions
        growing = len(portions) == 1 and sizes[-1] < LEAST
    if growing and len(sizes) > 1 and sizes[-1] < TAIL and sizes[-2] + sizes[-1] <= MOST:
        sizes[-2:] = [sizes[-2] + sizes[-1]]
    ends = list(accumulate(sizes))
    return [(spans[end - size][0], spans[end - 1][1]) for size, end in zip(sizes, ends, strict=True)]


def _structs(text: str, spans) -> list[dict]:
    return [{"start": a, "end": b, "text": text[a:b]} for a, b in spans]


@vectorised(SPANS)
def passages(s: pd.Series) -> pd.Series:
    return s.map(lambda t: _structs(t, cut_passages(t)) if t else [])


def cut_windows(text: str, most: int = 1800) -> list[tuple[int, int]]:
    """Windows of at most `most` characters that end at a sentence, else at a space, else anywhere."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + most)
        if end < len(text):
            part = text[start:end]
            stops = [m.end() for m in re.finditer(r"[.!?…][\"'’”)]*\s+", part)]
            space = part.rfind(" ")
            end = start + (stops[-1] if stops else space + 1 if space > 0 else len(part))
        out.append((start, end))
        start = end
    return out


@vectorised(SPANS)
def character_windows(s: pd.Series) -> pd.Series:
    return s.map(lambda t: _structs(t, cut_windows(t)) if t else [])


_LINE = re.compile("[^\r\n\u2028\u2029]*(\r\n|[\r\n\u2028\u2029]|$)")
_LABEL = re.compile(r"\s*(?:(?P<item>\[\d+\]|\d+[.)](?=\s|$))|(?P<under>\d+(?:\.\d+)*)\.(?P<number>\d+)[.)]?(?=\s|$))")


def cut_paragraphs(text: str) -> list[tuple[int, int]]:
    """Paragraphs as (start, end): runs of lines with words. A blank line, a paragraph separator, an item label ([3],
    3. or 3)) and a section number end a run; a number like 2.1 counts as a section only if the section before or after
    it under the same 2 is its neighbour."""
    lines = [m for m in _LINE.finditer(text) if m[0]]
    labels = [_LABEL.match(m[0]) for m in lines]
    sections: dict[str, list[tuple[int, int]]] = {}
    for i, label in enumerate(labels):
        if label and label["number"]:
            sections.setdefault(label["under"], []).append((i, int(label["number"])))
    opening = {i for i, label in enumerate(labels) if label and label["item"]}
    for numbered in sections.values():
        opening.update(i for (a, m), (b, n) in pairwise(numbered) if m + 1 == n for i in (a, b))
    out: list[list[int]] = []
    apart = True  # whether the next line with words begins a paragraph
    for i, line in enumerate(lines):
        end = line.start(1)
        if line[0].strip():
            if apart or i in opening:
                out.append([line.start(), end])
            out[-1][1] = end
        apart = not line[0].strip() or line[1] == "\u2029"
    return [(a, b) for a, b in out]


@vectorised(SPANS)
def paragraphs(s: pd.Series) -> pd.Series:
    return s.map(lambda t: _structs(t, cut_paragraphs(t)) if t else [])


# Abbreviations that end no sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Mme Mlle M Me Mtre v vs No Nos para paras s ss art arts al"
LONGEST = 1200  # characters of a sentence unit
_PIECE = r"(?s).{1,600}.{0,600}$|.{600}.{1,600} |.{1,600}.{0,600}"


def sentences(col: Column) -> Column:
    """Sentences of a text: cut at white space after . ! ? and closing signs, unless an abbreviation stands before it, a
    small letter after it, or initials (A.B.) before it and a digit after it. Blank lines divide too. What is longer
    than LONGEST goes in pieces, cut at the last space after half of that."""
    short = "|".join(ABBREVIATIONS.split())
    apart = r"(?<![\p{L}\p{N}])"
    initials = rf"(?:(?<!{apart}[A-Z]\.[A-Z]\.)|(?!\s+[0-9]))"
    cut = rf"(?<=[.!?][\"'’”)]{{0,3}})(?<!{apart}(?i:{short})\.){initials}\s+(?!\s|\p{{Ll}})|\n\s*\n"
    units = F.transform(F.split(F.regexp_replace(col, cut, "\u0001"), "\u0001"), lambda s: F.trim(s))
    pieces = F.transform(units, lambda s: F.when(F.length(s) <= LONGEST, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(_PIECE), F.lit(0))))
    return F.filter(F.transform(F.flatten(pieces), lambda s: F.trim(s)), lambda s: s != "")


def lines(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """keep, para and text: one row for each non-empty line."""
    return df.select(*keep, F.posexplode_outer(F.split(F.col(text), "\n")).alias("para", "line")).where(F.col("line").rlike(r"[^\p{Zs}]"))


def word_windows(words: Column, size: int = 120, stride: int = 96) -> Column:
    """Overlapping windows (start, words) of an array of words; the last one ends with the text."""
    count = F.greatest(F.lit(1), F.ceil((F.size(words) - size) / stride).cast("int") + 1)
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).alias("start"), F.slice(words, i * stride + 1, F.lit(size)).alias("words"))))


def budget_windows(words: Column, budget: int) -> Column:
    """Windows (start, words) of `budget` words that overlap by a quarter of it, 64 at most."""
    return word_windows(words, budget, budget - min(64, budget // 4))


def merged(spans: DataFrame, *keys: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and touching spans of a key as one (keys, start, end, parts)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", (F.coalesce(F.col(start) > far, F.lit(True))).cast("int"))
    island = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("__island", island).groupBy(*keys, "__island")
    return out.agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("__island")


def densest(hits: DataFrame, *keys: str, at: str = "start", term: str = "term", lead: int = 90, width: int = 460) -> DataFrame:
    """For each key the hit whose surroundings hold most distinct terms, the earliest of equals: (keys, anchor, distinct)."""
    around = Window.partitionBy(*keys).orderBy(at).rangeBetween(-lead, width - lead)
    counted = hits.withColumn("distinct", F.size(F.collect_set(term).over(around)))
    return counted.groupBy(*keys).agg(F.max_by(at, F.struct("distinct", -F.col(at))).alias("anchor"), F.max("distinct").alias("distinct"))


def excerpt(text: Column, anchor: Column, lead: int = 90, width: int = 460) -> Column:
    start = F.greatest(F.lit(0), anchor - lead)
    return F.substring(text, start + 1, F.lit(width))


def marks(hits: Column, start: Column, width: int = 460, most: int = 50) -> Column:
    """Hits (start, end) inside an excerpt, relative to it, at most `most`."""
    inside = F.filter(hits, lambda h: (h["start"] >= start) & (h["end"] <= start + width))
    return F.slice(F.transform(inside, lambda h: F.struct((h["start"] - start).alias("start"), (h["end"] - start).alias("end"))), 1, most)


def ends(units: DataFrame, *keys: str, start: str = "start", total: str = "total", tie: tuple[str, ...] = ()) -> DataFrame:
    """Units that end where the next one starts, the last with the whole; units of one start go by `tie`."""
    return units.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start, *tie)), F.col(total)))


def containing(points: DataFrame, ranges: DataFrame, point: str, first: str, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each point with the greatest range start at or before it, by one sorted pass inside the keys and no range join.
    Columns of ranges in `carry` come along; of ranges with one start those of the greatest count."""
    known = [F.col(c).isNotNull() for c in (first, *keys)]
    own = ranges.where(functools.reduce(Column.__and__, known))
    right = own.select(*keys, F.col(first).alias(point), F.struct(first, *carry).alias("__range"), F.lit(0).alias("__kind"))
    left = points.select("*", F.lit(None).cast(right.schema["__range"].dataType).alias("__range"), F.lit(1).alias("__kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(point, "__kind", "__range").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__range", F.last("__range", ignorenulls=True).over(order)).where("__kind = 1")
    return both.withColumns({c: F.col(f"__range.{c}") for c in (first, *carry)}).drop("__range", "__kind")


def longest_run(values: list[int], step: int = 2, first: int = 3, least: int = 3) -> list[int]:
    """Indices of the longest run of printed numbers, the earliest of equal ones; none under `least` items.

    A run starts with a number up to `first` and takes, going on, the next number that is greater by 1 to `step`, also
    where leaving that one out would make it longer. Read from the end, so that each number knows what follows it.
    """
    after: dict[int, int] = {}  # the nearest place of a number to the right
    follows, length = [-1] * len(values), [1] * len(values)
    for i in range(len(values) - 1, -1, -1):
        near = [after[values[i] + d] for d in range(1, step + 1) if values[i] + d in after]
        if near:
            follows[i] = min(near)
            length[i] += length[follows[i]]
        after[values[i]] = i
    i = max((j for j, v in enumerate(values) if v <= first), key=lambda j: (length[j], -j), default=-1)
    out = []
    while i >= 0:
        out.append(i)
        i = follows[i]
    return out if len(out) >= least else []


@vectorised("array<int>")
def longest_runs(s: pd.Series) -> pd.Series:
    return s.map(lambda v: longest_run([int(x) for x in v]))


def overlapping(selections: DataFrame, units: DataFrame, *keys: str, start: str = "start", end: str = "end") -> DataFrame:
    """Selections (keys, s_id, start, end) with the units (keys, u_id, start, end) that they overlap, half open; what is
    empty overlaps nothing."""
    a = selections.where(F.col(start) < F.col(end)).select(*keys, "s_id", F.col(start).alias("__s"), F.col(end).alias("__e"))
    b = units.where(F.col(start) < F.col(end)).select(*keys, "u_id", F.col(start).alias("__from"), F.col(end).alias("__to"))
    return a.join(b, list(keys)).where("__s < __to AND __from < __e").select(*keys, "s_id", "u_id")


def numbered(lines: DataFrame, *keys: str, text: str = "line", longer: int = 200, many: int = 20, share: float = 0.3) -> DataFrame:
    """Keys whose paragraph numbers are accepted: `many` of the long lines have one, or `share` of them."""
    long = lines.where(F.length(text) > longer).groupBy(*keys).agg(F.count(F.lit(1)).alias("long"), F.sum(F.col(text).rlike(r"^\s*(?:\[[0-9]{1,4}\]|[0-9]{1,4}[.)])\s").cast("int")).alias("hit"))
    return long.where((F.col("hit") >= many) | (F.col("hit") >= share * F.col("long"))).select(*keys)


def intact(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether a quotation still stands where it was taken from."""
    return F.coalesce(F.substring(text, start + 1, end - start) == quote, F.lit(False))


def consecutive(df: DataFrame, *keys: str, value: str, order: str, least: int = 3) -> DataFrame:
    """Keys whose values are consecutive numbers, `least` of them or more."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__step", step).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("__step") == 1, F.lit(True))).alias("__ok")).where((F.col("n") >= least) & F.col("__ok")).drop("__ok")


def sticky(df: DataFrame, flag: Column, *keys: str, order: str, to: str = "quoted") -> DataFrame:
    """A flag that stays set for the rest of the key once it was."""
    return df.withColumn(to, F.max(flag).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def provision_chains(markers: DataFrame, *keys: str, order: str, rank: str = "rank", label: str = "label", ranks: int = 8) -> DataFrame:
    """markers with `chain`: the labels each one stands under, by the nearest earlier marker of every lower rank, and its
    own. A marker ends those of its rank and above; ranks go from 0 to ranks - 1."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(rank) == r, F.struct(F.col(order).alias("at"), F.col(label).alias("label"))), ignorenulls=True).over(before) for r in range(ranks)]
    rows = markers.withColumn("__last", F.array(*last))
    # One still stands if no marker of a lower rank came after it.
    below = lambda x, r: F.forall(F.slice("__last", F.lit(1), r), lambda q: q.isNull() | (q["at"] < x["at"]))
    standing = F.filter("__last", lambda x, r: x.isNotNull() & (r < F.col(rank)) & below(x, r))
    return rows.withColumn("chain", F.concat(F.transform(standing, lambda x: x["label"]), F.array(label))).drop("__last")


def reflowed(lines: DataFrame, *keys: str, y: str = "y", height: str = "height", text: str = "text", tie: tuple[str, ...] = (), gap: float = 1.7) -> DataFrame:
    """(keys, paragraph, text) of printed lines (y, height, text): a gap of more than `gap` heights divides."""
    order = Window.partitionBy(*keys).orderBy(y, *tie)
    starts = F.coalesce((F.col(y) - F.lag(y).over(order) > gap * F.col(height)).cast("int"), F.lit(0))
    rows = lines.withColumn("__starts", starts).withColumn("paragraph", F.sum("__starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(y, *tie, F.col(text).alias("__text")))), lambda x: x["__text"]), " ").alias("text"))
