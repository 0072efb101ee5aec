"""Finding and making text fragment directives over plain text."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from urllib.parse import quote, unquote

import pandas as pd

from .vectorised import vectorised

MOST_TRIES, MOST_LENGTH = 600, 7000


@lru_cache(maxsize=8)
def search_key(text: str) -> tuple[str, list[int]]:
    """The text as a page search sees it (folded quotes, compatibility forms, no ignorable signs), and the place of
    each of its characters in the original."""
    out, at = [], []
    for i, c in enumerate(text):
        if unicodedata.category(c) == "Cf":
            continue
        for d in unicodedata.normalize("NFKD", {"‘": "'", "’": "'", "“": '"', "”": '"', "\xa0": " "}.get(c, c)).lower():
            if not unicodedata.combining(d):
                if d.isspace():
                    if out and out[-1] == " ":
                        continue
                    d = " "
                out.append(d)
                at.append(i)
    return "".join(out), at


def parse(directive: str) -> dict:
    """prefix, start, end and suffix of a directive's body or of a whole URL; empty where it has none."""
    body = directive.partition(":~:text=")[2] or directive
    out = dict.fromkeys(("prefix", "start", "end", "suffix"), "")
    rest = []
    for part in body.split("&")[0].split(","):
        if part.endswith("-") and not out["prefix"] and not rest:
            out["prefix"] = unquote(part[:-1])
        elif part.startswith("-"):
            out["suffix"] = unquote(part[1:])
        else:
            rest.append(unquote(part))
    out["start"], out["end"] = (rest + ["", ""])[:2]
    return out


def _word(text: str, term: str, start: int):
    """The next place of a term that begins and ends at word limits."""
    at = text.find(term, start)
    while at >= 0:
        end = at + len(term)
        if not (at and text[at - 1].isalnum() and term[0].isalnum()) and not (end < len(text) and text[end].isalnum() and term[-1].isalnum()):
            return at, end
        at = text.find(term, at + 1)
    return None


def find(text: str, directive: str) -> tuple[int, int] | None:
    """The first span that a directive names: after its prefix the start, then the first end, then its suffix."""
    key, at = search_key(text)
    d = {k: search_key(v)[0].strip() for k, v in parse(directive).items()}
    if not d["start"]:
        return None
    place = 0
    while True:
        head = _word(key, d["prefix"], place) if d["prefix"] else (0, place)
        if head is None:
            return None
        begin = len(key[: head[1]]) + (len(key[head[1] :]) - len(key[head[1] :].lstrip())) if d["prefix"] else head[1]
        found = _word(key, d["start"], begin)
        if found is None:
            return None
        if d["prefix"] and found[0] != begin:
            place = head[0] + 1
            continue
        stop = _word(key, d["end"], found[1]) if d["end"] else found
        if stop is None:
            return None
        if d["suffix"]:
            tail = key[stop[1] :].lstrip()
            after = _word(tail, d["suffix"], 0)
            if after is None or after[0]:
                place = (head[0] if d["prefix"] else found[0]) + 1
                continue
        return at[found[0]], at[stop[1] - 1] + 1


def make(text: str, start: int, end: int) -> str | None:
    """A directive that leads to text[start:end], widened to whole words, and nowhere before it: the passage, then with
    words around it."""
    def enc(s):
        return quote(s, safe="").replace("-", "%2D")

    while 0 < start < len(text) and text[start - 1].isalnum() and text[start].isalnum():
        start -= 1
    while 0 < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    body = text[start:end]
    words = body.split()
    if not words:
        return None
    before, after = text[max(0, start - 400) : start].split(), text[end : end + 400].split()
    forms = [enc(" ".join(words))] if len(body) <= 300 else []
    forms += [f"{enc(' '.join(words[:n]))},{enc(' '.join(words[-n:]))}" for n in range(1, min(12, len(words) // 2) + 1)]
    tries = 0
    for context in range(0, 13):
        for form in forms:
            pre = f"{enc(' '.join(before[-context:]))}-," if context and before else ""
            post = f",-{enc(' '.join(after[:context]))}" if context and after else ""
            directive = f":~:text={pre}{form}{post}"
            tries += 1
            if tries > MOST_TRIES or len(directive) > MOST_LENGTH:
                return None
            got = find(text, directive)
            if got and re.sub(r"\s+", " ", text[got[0] : got[1]]).strip() == " ".join(words) and abs(got[0] - start) <= len(body) - len(body.lstrip()):
                return directive
    return None


@vectorised("struct<start: int, end: int>")
def find_directive(text: pd.Series, directive: pd.Series) -> pd.DataFrame:
    found = [find(t or "", d or "") or (None, None) for t, d in zip(text, directive, strict=True)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


@vectorised("string")
def make_directive(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([make(t or "", int(a), int(b)) for t, a, b in zip(text, start, end, strict=True)])
