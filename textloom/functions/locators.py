"""Hierarchical locators like 8(1)(a): parsing, ancestry, decoding of anchor tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^([0-9]+(?:\.[0-9]+)*)((?:\([^()]+\))*)$"
# Names of the parts of an anchor token.
ROOTS = "sec section art article rule"
PARTS = "subsec subsection para paragraph subpara subparagraph clause subclause"


def root(col: Column) -> Column:
    return F.regexp_extract(col, SHAPE, 1)


def suffixes(col: Column) -> Column:
    return F.regexp_extract_all(F.regexp_extract(col, SHAPE, 2), F.lit(r"\(([^()]+)\)"), F.lit(1))


def parse(col: Column) -> Column:
    """Struct of root, numbers of the root and suffixes; null where the locator is malformed."""
    body = F.trim(F.regexp_replace(col, r"\s+", " "))
    parsed = F.struct(root(body).alias("root"), F.transform(F.split(root(body), r"\."), lambda x: x.try_cast("int")).alias("root_parts"), suffixes(body).alias("suffixes"))
    return F.when(body.rlike(SHAPE), parsed)


def depth(col: Column) -> Column:
    return F.size(suffixes(col))


def level(col: Column) -> Column:
    """Number of suffixes that are no numbers."""
    return F.size(F.filter(suffixes(col), lambda s: ~s.rlike("^[0-9]+$")))


def ancestors(col: Column) -> Column:
    """Proper ancestors, outermost first: 8(1)(a) has 8 and 8(1)."""
    parts = suffixes(col)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(root(col), F.array_join(F.transform(F.slice(parts, F.lit(1), n), lambda s: F.concat(F.lit("("), s, F.lit(")"))), "")))).otherwise(F.array().cast("array<string>"))


def decode(col: Column) -> Column:
    """sec7subsec2 as 7(2); null where the token has other parts."""
    token = F.regexp_replace(col, "^#", "")
    name = "|".join(sorted(PARTS.split(), key=len, reverse=True))
    whole = f"(?i)^(?:{'|'.join(sorted(ROOTS.split(), key=len, reverse=True))})([0-9]+(?:\\.[0-9]+)*)((?:(?:{name})[A-Za-z0-9.-]+?)*)$"
    tail = F.regexp_extract(token, whole, 2)
    parts = F.regexp_extract_all(tail, F.lit(f"(?i)(?:{name})([A-Za-z0-9.-]+?)(?=(?:{name})|$)"), F.lit(1))
    out = F.concat(F.regexp_extract(token, whole, 1), F.array_join(F.transform(parts, lambda s: F.concat(F.lit("("), s, F.lit(")"))), ""))
    return F.when(token.rlike(whole), out)


def page_marker(col: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(col), r"(?i)^\[page\s+([0-9]+)\]$", 1), F.lit(""))


PINPOINTS = {"page": "p", "paragraph": "para", "section": "s", "rule": "r", "article": "art"}


def pinpoint(kind: Column, locator: Column) -> Column:
    """A locator with the short name of its kind."""
    names = F.create_map(*[F.lit(x) for pair in PINPOINTS.items() for x in pair])
    return F.trim(F.concat_ws(" ", F.coalesce(F.try_element_at(names, kind), F.lit("")), locator))
