"""Dated mentions in English and French text, with calendar checks and ambiguity kept."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorised import vectorised

# Names of months and weekdays, and relative days.
MONTHS = "january jan janvier janv; february feb février fevrier févr fevr; march mar mars; april apr avril avr; may mai; june jun juin; july jul juillet juil; august aug août aout; september sep sept septembre; october oct octobre; november nov novembre; december dec décembre decembre déc"
WEEKDAYS = "monday mon lundi lun; tuesday tue tues mardi mar; wednesday wed mercredi mer; thursday thu thur thurs jeudi jeu; friday fri vendredi ven; saturday sat samedi sam; sunday sun dimanche dim"
RELATIVE = {"today": 0, "yesterday": -1, "tomorrow": 1, "aujourd'hui": 0, "hier": -1, "demain": 1}

_NUMBER = {name: i for names in (MONTHS, WEEKDAYS) for i, group in enumerate(names.split(";")) for name in group.split()}
_ANY_MONTH = "|".join(sorted(re.findall(r"[^\s;]+", MONTHS), key=len, reverse=True))
SCHEMA = "array<struct<start: int, end: int, raw: string, date: string, reason: string, alternatives: array<string>>>"
# What a reading says when it is no plain date.
NO_DAY = "the calendar has no such day"
TWO_READINGS = "day and month can be read both ways"
NO_YEAR = "the year is missing"
COUNTED = "counted from the date of the message"
NO_ANCHOR = "nothing dated to count from"
# One scanner: the forms in the order in which they claim text, each with the parts of a date as named groups.
FORMS = {
    "iso": r"\b(?P<y>(?:19|20)\d\d)-(?P<m>\d\d)-(?P<d>\d\d)\b",
    "slashed": r"\b(?P<one>\d\d?)[/-](?P<two>\d\d?)[/-](?P<y>(?:19|20)\d\d)\b",
    "day_month": rf"\b(?P<d>\d\d?)(?:st|nd|rd|th|er)?\s+(?:day\s+of\s+)?(?P<name>{_ANY_MONTH})\b\.?(?:\s*,?\s*(?P<y>(?:19|20)\d\d)\b)?",
    "month_day": rf"\b(?P<name>{_ANY_MONTH})\b\.?\s+(?P<d>\d\d?)(?:st|nd|rd|th)?\b(?:\s*,?\s*(?P<y>(?:19|20)\d\d)\b)?",
    "spoken": r"\b(?P<word>" + "|".join(RELATIVE) + r")\b",
}
_FORMS = [(form, re.compile(pattern, re.IGNORECASE)) for form, pattern in FORMS.items()]


def calendar(year, month, day) -> str | None:
    try:
        return dt.date(int(year), int(month), int(day)).isoformat()
    except ValueError:
        return None


def _reading(form: str, part: dict, before: str, anchor: dt.date | None) -> tuple[str | None, list[str], str]:
    """Date, alternatives and remark of one match; `before` is the text shortly before it."""
    if form == "spoken":
        if anchor is None:
            return None, [], NO_ANCHOR
        return (anchor + dt.timedelta(days=RELATIVE[part["word"].lower()])).isoformat(), [], COUNTED
    if form == "slashed":
        days = {calendar(part["y"], m, d): None for d, m in ((part["one"], part["two"]), (part["two"], part["one"]))}
        days.pop(None, None)
        words = re.findall(r"[^\W\d_]+", before)
        weekday = _NUMBER.get(words[-1].lower()) if words and words[-1].lower() in WEEKDAYS.replace(";", " ").split() else None
        said = [d for d in days if weekday is None or len(days) == 1 or dt.date.fromisoformat(d).weekday() == weekday]
        return (said[0], said, "") if len(said) == 1 else (None, said, TWO_READINGS if said else NO_DAY)
    if not part["y"]:
        return None, [], NO_YEAR
    month = part["m"] if form == "iso" else _NUMBER[part["name"].lower()] + 1
    date = calendar(part["y"], month, part["d"])
    return date, [], "" if date else NO_DAY


def candidates(text: str, anchor: str | None = None) -> list[dict]:
    """Dates of a text in order of place. Where two forms claim the same characters, the one that FORMS lists first has
    them. Relative days need an ISO anchor; what is no plain date says why, ambiguous ones with both readings."""
    day = dt.date.fromisoformat(anchor) if anchor and re.fullmatch(r"\d{4}-\d\d-\d\d", anchor) else None
    taken = bytearray(len(text))
    found = []
    for form, pattern in _FORMS:
        for m in pattern.finditer(text):
            if any(taken[m.start() : m.end()]):
                continue
            taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
            date, others, remark = _reading(form, m.groupdict(), text[max(0, m.start() - 12) : m.start()], day)
            found.append({"start": m.start(), "end": m.end(), "raw": m[0], "date": date, "reason": remark, "alternatives": others})
    return sorted(found, key=lambda f: f["start"])


@vectorised(SCHEMA)
def date_candidates(text: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([candidates(t or "", a or None) for t, a in zip(text, anchor, strict=True)])


def iso_dates(col: Column) -> Column:
    """Valid ISO dates of a text, without Python."""
    found = F.regexp_extract_all(col, F.lit(r"\b((?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})\b"), F.lit(1))
    return F.filter(found, lambda x: F.try_to_date(x).isNotNull())


def date_heading(text: str) -> bool:
    """A line that is one date and signs around it."""
    found = candidates(text)
    return len(found) == 1 and not re.sub(r"[\s:,.\[\]()–—-]", "", text[: found[0]["start"]] + text[found[0]["end"] :])


def padded(day: Column, digit: str) -> Column:
    """A partial YYYY[MM[DD]] bound as an integer: `from` is padded with 0, `to` with 9."""
    return F.rpad(F.regexp_replace(day, "[^0-9]", ""), 8, digit).cast("int")


def date_number(day: Column) -> Column:
    """YYYYMMDD, 0 where there is none: such rows pass an upper bound alone, never a lower one."""
    return F.coalesce(F.regexp_replace(day.cast("string"), "[^0-9]", "").substr(1, 8).try_cast("int"), F.lit(0))
