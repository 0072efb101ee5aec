"""Benchmark decontamination by canonical templates, hash-joined windows and slot consistency.

Words are runs of letters or digits. Numbers, units after numbers, and capitalised words inside a sentence become
typed placeholders; all other words count by their case-folded form. Windows of consecutive words whose templates
agree are joined by hash, so a question with other numbers or names still meets its source. The aligned windows of a
text and an item must then fill the placeholders consistently: one filler of the item always stands for the same
filler of the text, within an alignment and across the alignments that are counted together. A text is contaminated by an item when consistent windows cover enough of the item's words.

Windows are also joined by their case-folded words, whatever they are, so copies with few or no literals count too,
and so do items shorter than LITERALS. Characters of scripts without spaces are words of their own. What stands before
a window decides whether its first word looks like a name or a unit, so that word is tried both ways.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, row_key, without, written
from .wordhash import chunks, hashes, mix

WINDOW = 6
LITERALS = 3  # a window needs so many words that are no placeholders
COVERAGE = 0.6
RUN = 13  # words of an item in a row that make a leak, whatever share of the item they are
BITS = 1 << 24  # of the map of benchmark windows that spares a join of all windows of all texts
BROADCAST_ROWS = 100_000  # benchmark windows up to which their table is sent to every task
# Number words and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces l ml liter liters litre litres gallon gallons s ms min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent k c f degrees mph kmh hz khz mhz ghz kb mb gb tb w kw j kj v a n pa"
_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_UPPER, _LOWER = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122)
_LETTER = _UPPER | _LOWER | (_B >= 128)
_STOP = np.isin(_B, list(b".!?\n"))
_POINT = np.isin(_B, list(b".,"))
NUMBER, UNIT, NAME = 1, 2, 3
BASE, OTHER, EXACT = 0, 1, 2  # how a window was met: by its template, with its first word taken the other way, by its words


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of punctuation beyond ASCII, and first bytes of characters that are words of their own and of what follows them."""
    gap, cut = np.zeros(len(data), bool), np.zeros(len(data) + 4, bool)
    at = np.flatnonzero(data >= 0xC2)
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    size = np.where(a >= 0xF0, 4, np.where(a >= 0xE0, 3, 2))
    mark = (a == 0xC2) & ~np.isin(b, [0xAA, 0xB5, 0xBA]) | (a == 0xE2) & np.isin(b, [0x80, 0x81])
    mark |= (a == 0xE3) & (b == 0x80) & ~((c >= 0x85) & (c <= 0x87))
    mark |= (a == 0xEF) & ((b == 0xBC) & ((c <= 0x8F) | (c >= 0x9A) & (c <= 0xA0) | (c >= 0xBB)) | (b == 0xBD) & ((c == 0x80) | (c >= 0x9B) & (c <= 0xA5)))
    # Han, kana and full-width forms; Thai, Lao, Burmese and Khmer; rarer Han.
    own = (a == 0xE2) & (b >= 0xBA) | (a >= 0xE3) & (a <= 0xE9) | (a == 0xEF) & ((b >= 0xA4) & (b <= 0xAB) | (b >= 0xBC) & (b <= 0xBE))
    own |= (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F)) | (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    for j in range(4):
        gap[np.minimum(at[mark & (size > j)] + j, len(data) - 1)] = True
    own &= ~mark
    cut[at[own]] = cut[at[own] + size[own]] = True
    return gap, cut[: len(data)]


def _word_set(words: str) -> np.ndarray:
    data = np.frombuffer(words.encode(), np.uint8)
    at = np.flatnonzero(data == 32)
    return np.sort(hashes(data, np.concatenate(([0], at + 1)), np.concatenate((at, [len(data)]))))


def canonical(data: np.ndarray, off: np.ndarray):
    """For each word: byte start, end, template hash, kind (0 for a literal); and the words before each text."""
    return _canonical(data, off)[:5]


def _canonical(data: np.ndarray, off: np.ndarray):
    """What canonical gives, and for each word its own hash and whether it would be a name inside a sentence."""
    empty = np.zeros(0, np.int64)
    if not len(data):
        return empty, empty, empty.view(np.uint64), empty, np.zeros(len(off), np.int64), empty.view(np.uint64), empty.astype(bool)
    digit, letter = _DIGIT[data], _LETTER[data]
    inner = np.zeros(len(data), bool)
    inner[1:-1] = _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    numeric = digit | inner
    gap, cut = _wide(data)
    kind = np.where(numeric, 1, np.where(letter & ~gap, 2, 0)).astype(np.int8)
    first = off[:-1][off[:-1] < len(data)]
    opens = np.zeros(len(data), bool)
    opens[first] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | opens | cut
    start = np.flatnonzero(change & (kind > 0))
    stops = np.flatnonzero(np.concatenate((change[1:], [True])) & (kind > 0)) + 1
    words = np.searchsorted(start, off)
    folded = hashes(data, start, stops)
    number = numeric[start] | np.isin(folded, _NUMBERS)
    sentence = np.concatenate(([0], np.cumsum(_STOP[data])))
    fresh = np.ones(len(start), bool)
    fresh[1:] = sentence[start[1:]] > sentence[stops[:-1]]
    fresh[words[:-1][words[:-1] < len(start)]] = True
    second = np.where(stops - start > 1, data[np.minimum(start + 1, len(data) - 1)], 0)
    capital = ~number & _UPPER[data[start]] & _LOWER[second]
    name = ~fresh & capital
    after = np.concatenate(([False], number[:-1]))
    unit = ~number & ~name & after & np.isin(folded, _UNITS)
    what = np.select([number, unit, name], [NUMBER, UNIT, NAME], 0)
    return start, stops, np.where(what > 0, what.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), folded), what, words, folded, capital


_NUMBERS, _UNITS = _word_set(NUMBER_WORDS), _word_set(UNITS)


def _hashed(template: np.ndarray, at: np.ndarray, size: int, seed: int, first: np.ndarray | None = None) -> np.ndarray:
    h = np.full(len(at), seed, np.uint64)
    for j in range(size):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + (first if j == 0 and first is not None else template[at + j]))
    return h


def windows(template: np.ndarray, kinds: np.ndarray, words: np.ndarray, size: int, folded: np.ndarray, capital: np.ndarray | None = None):
    """First words, hashes and ways of all windows of `size` words that lie in one text: those with enough literals by
    their template, with `capital` also with the first word taken the other way, and all by their words."""
    total = max(len(template) - size + 1, 0)
    at = np.arange(total)
    at = at[at + size <= np.repeat(words[1:], np.diff(words))[:total]]
    literal = np.concatenate(([0], np.cumsum(kinds == 0)))
    enough = literal[at + size] - literal[at]
    base = at[enough >= LITERALS]
    found = [(base, _hashed(template, base, size, size), BASE), (at, _hashed(folded, at, size, size + 1000), EXACT)]
    if capital is not None:
        was, named = kinds[at] > 0, np.uint64(NAME) * np.uint64(0x9E3779B97F4A7C15)
        turned = (was & (kinds[at] != NUMBER) | ~was & capital[at]) & (enough + np.where(was, 1, -1) >= LITERALS)
        other = at[turned]
        found.append((other, _hashed(template, other, size, size, np.where(was[turned], folded[other], named)), OTHER))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), np.repeat([x[2] for x in found], [len(x[0]) for x in found])


def _fillers(data, start, stops, kinds, at: int, size: int, how: int = BASE) -> list[str]:
    if how == EXACT:
        return []
    what = [int(k) for k in kinds[at : at + size]]
    if how == OTHER:
        what[0] = 0 if what[0] else NAME
    return [f"{k}{bytes(data[start[i] : stops[i]]).decode(errors='replace').lower()}" for i, k in enumerate(what, at) if k]


def _item_windows(items: DataFrame, id_col: str, text: str) -> DataFrame:
    schema = "item long, words int, size int, pos int, hash long, theirs array<string>"

    def read(batches):
        for batch in batches:
            out = []
            ids = batch.column(0).to_pylist()
            for a, b, data, off in chunks(batch.column(1)):
                start, stops, template, kinds, words, folded, _ = _canonical(data, off)
                for i in range(b - a):
                    lo, n = int(words[i]), int(words[i + 1] - words[i])
                    size = min(n, WINDOW)
                    if not size:
                        continue
                    at, h, how = windows(template[lo : lo + n], kinds[lo : lo + n], np.array([0, n]), size, folded[lo : lo + n])
                    out += [(ids[a + i], n, size, p, x, _fillers(data, start, stops, kinds, lo + p, size, w)) for p, x, w in zip(at.tolist(), h.view(np.int64).tolist(), how.tolist(), strict=True)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])

    return items.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(read, schema)


def _text_hits(docs: DataFrame, id_col: str, text: str, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """Windows of the texts whose hash may be one of the benchmark's."""
    schema = "id long, key struct<a: long, b: long>, size int, at long, hash long, how int, ours array<string>"
    used = np.flatnonzero(bits)
    values = bits[used]

    def read(batches):
        table = np.zeros(BITS // 64, np.uint64)
        table[used] = values
        for batch in batches:
            out = []
            for a, _, data, off in chunks(batch.column(2)):
                start, stops, template, kinds, words, folded, capital = _canonical(data, off)
                for size in sizes:
                    at, h, how = windows(template, kinds, words, size, folded, capital)
                    cell = h & np.uint64(BITS - 1)
                    hit = (table[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
                    at, h, how = at[hit], h[hit], how[hit]
                    row = np.searchsorted(words, at, "right") - 1
                    out += [(a + r, size, p - int(words[r]), x, w, _fillers(data, start, stops, kinds, p, size, w)) for r, p, x, w in zip(row.tolist(), at.tolist(), h.view(np.int64).tolist(), how.tolist(), strict=True)]
            row = pa.array([x[0] for x in out], pa.int64())
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array([x[j] for x in out], t) for j, t in enumerate(types, 1))], names=["id", "key", "size", "at", "hash", "how", "ours"])

    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text).alias("key"), F.col(text).alias("text")).mapInArrow(read, schema)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Rows (key, id, item, windows, coverage), one for each contaminated text and item; clean texts give none.

    windows counts the item's matched windows, coverage is the share of its words inside them. Items with fewer words
    than WINDOW are one window; below LITERALS words it matches by its words only. Null and empty items match nothing,
    nor do null and empty texts. RUN of an item's words in a row contaminate whatever the coverage: in windows that agree,
    or word by word even where the fillers around them do not. Of several alignments of a text and an item, those with
    more windows go first, and one whose fillers contradict them counts only by its words. Equal rows are one text, rows
    of one id with different texts are several; a null id is carried along. Texts of any length are read whole, other
    columns are ignored. Empty tables give no rows.
    """
    ready(docs.sparkSession)
    bench = written(_item_windows(items, item_id, item_text), "items")
    rows = bench.count()
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # WINDOW values at most
    bits = np.zeros(BITS // 64, np.uint64)
    cell = bench.select(F.expr(f"hash & {BITS - 1}").alias("b"))
    for at, word in cell.groupBy(F.expr("b div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("w")).collect():
        bits[at] = np.uint64(word % (1 << 64))
    hits = _text_hits(docs, id_col, text, sizes, bits)
    met = hits.join(F.broadcast(bench) if rows <= BROADCAST_ROWS else bench, ["hash", "size"])
    # One alignment of a text and an item has no more windows than the item.
    pairs = lambda *how: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("how").isin(*how), F.arrays_zip("theirs", "ours")))))
    places = lambda how: F.collect_set(F.when(F.col("how") == how, F.col("pos")))
    agrees = lambda c: F.size(c) == F.size(F.array_distinct(F.col(c)["theirs"]))
    line = met.groupBy("key", "item", (F.col("at") - F.col("pos")).alias("shift")).agg(
        F.first("id").alias("id"),
        F.first("words").alias("words"),
        F.first("size").alias("size"),
        places(BASE).alias("base"),
        places(OTHER).alias("other"),
        places(EXACT).alias("exact"),
        pairs(BASE).alias("filled"),
        pairs(BASE, OTHER).alias("filled_too"),
    )
    none = F.array().cast("array<int>")
    every = F.array_union(F.array_union("base", "exact"), F.when(agrees("filled_too"), F.col("other")).otherwise(none))
    line = line.withColumn("pos", F.array_sort(F.when(agrees("filled"), every).otherwise(F.col("exact"))))
    # Sorted distinct places are consecutive where so many of them span no more than that many.
    more = RUN - F.col("size")
    line = line.withColumn("run", F.exists(F.sequence(F.lit(0), F.greatest(F.size("pos") - 1, F.lit(0))), lambda i: F.get("pos", i + more) - F.get("pos", i) == more))
    line = line.where(agrees("filled") | F.col("run"))
    # Alignments are taken from the one with most windows on; one whose fillers contradict those taken before gives
    # only the windows that agree word by word.
    nothing = F.array().cast("array<struct<theirs: string, ours: string>>")
    filled = F.when(agrees("filled"), F.when(agrees("filled_too"), F.col("filled_too")).otherwise(F.col("filled"))).otherwise(nothing)
    alignment = F.struct((-F.size("pos")).alias("order"), "shift", "pos", "exact", filled.alias("filled"))
    whole = line.groupBy("key", "item").agg(F.first("id").alias("id"), F.first("words").alias("words"), F.first("size").alias("size"), F.array_sort(F.collect_list(alignment)).alias("lines"), F.coalesce(F.bool_or("run"), F.lit(False)).alias("run"))

    def taken(done, new):
        both = F.array_union(done["filled"], new["filled"])
        fits = F.size(both) == F.size(F.array_distinct(both["theirs"]))
        return F.struct(F.array_union(done["pos"], F.when(fits, new["pos"]).otherwise(new["exact"])).alias("pos"), F.when(fits, both).otherwise(done["filled"]).alias("filled"))

    start = F.struct(none.alias("pos"), nothing.alias("filled"))
    whole = whole.withColumn("pos", F.aggregate("lines", start, taken)["pos"])
    covered = F.size(F.array_distinct(F.flatten(F.transform("pos", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    whole = whole.select("key", "id", "item", F.size("pos").cast("long").alias("windows"), (covered / F.col("words")).alias("coverage"), "run")
    return whole.where((F.col("coverage") >= coverage) | F.col("run")).drop("run")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of docs that no item contaminates, unchanged, repeated rows and rows without id or text included; docs may
    have columns of any names. Empty docs stay empty, without items all rows stay."""
    found = written(contaminated(docs, items, id_col, text, **more).select("key").distinct(), "found")
    return without(docs, row_key(id_col, text), found)
