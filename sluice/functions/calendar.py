"""Calendar buckets: labels of dates, and what a label covers.

Labels: day 2026-08-11, week 2026-W33 (ISO week and week-year), month 2026-08, quarter 2026-Q3,
year 2026. Nothing closes a bucket: a late row only makes it dirty again.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("day", "week", "month", "quarter", "year")
_FORMS = {
    "day": re.compile(r"(\d{4})-(\d\d)-(\d\d)"),
    "month": re.compile(r"(\d{4})-(\d\d)"),
    "quarter": re.compile(r"(\d{4})-Q([1-4])"),
    "week": re.compile(r"(\d{4})-W(\d\d)"),
    "year": re.compile(r"(\d{4})"),
}


def label(kind: str, date: Column | str) -> Column:
    """The label of a date or timestamp column; null for null."""
    d = F.to_date(F.col(date) if isinstance(date, str) else date)
    if kind == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if kind == "month":
        return F.date_format(d, "yyyy-MM")
    if kind == "year":
        return F.date_format(d, "yyyy")
    if kind == "quarter":
        return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))
    if kind == "week":
        return F.concat(F.lpad(F.date_part(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    raise ValueError(f"unknown calendar bucket {kind!r}; one of {', '.join(KINDS)}")


def label_of(kind: str, day: dt.date) -> str:
    if kind == "week":
        year, week, _ = day.isocalendar()
        return f"{year:04d}-W{week:02d}"
    if kind == "quarter":
        return f"{day.year:04d}-Q{(day.month + 2) // 3}"
    return day.isoformat()[: {"day": 10, "month": 7, "year": 4}[kind]]


def parse(text: str) -> tuple[str, dt.date]:
    """Kind and first day of a label; ValueError if it is none."""
    for kind, form in _FORMS.items():
        if m := form.fullmatch(text):
            n = [int(x) for x in m.groups()]
            if kind == "week":
                return kind, dt.date.fromisocalendar(n[0], n[1], 1)
            month = {"day": lambda: n[1], "month": lambda: n[1], "quarter": lambda: 3 * n[1] - 2, "year": lambda: 1}[kind]()
            return kind, dt.date(n[0], month, n[2] if kind == "day" else 1)
    raise ValueError(f"{text!r} is no calendar label")


def bounds(kind: str, text: str) -> tuple[dt.date, dt.date]:
    """First day of a label's bucket and first day after it."""
    found, first = parse(text)
    if found != kind:
        raise ValueError(f"{text!r} is a {found}, not a {kind}")
    if kind in ("day", "week"):
        return first, first + dt.timedelta(days=7 if kind == "week" else 1)
    months = first.month - 1 + {"month": 1, "quarter": 3, "year": 12}[kind]
    return first, dt.date(first.year + months // 12, months % 12 + 1, 1)


def bucket_of_key(kind: str, key: str) -> str:
    """The bucket that holds a key's first segment, itself a label of the same or a finer kind."""
    return label_of(kind, parse(key.split("|", 1)[0])[1])


def bucket_of_key_column(kind: str, key: Column) -> Column:
    """Column form of ``bucket_of_key``; null where the first segment is no label."""
    head = F.split_part(key, F.lit("|"), F.lit(1))
    year = F.substring(head, 1, 4)
    week_start = F.date_add(F.trunc(F.try_to_date(F.concat(year, F.lit("-01-04"))), "week"), 7 * (F.substring(head, 7, 2).try_cast("int") - 1))
    day = (
        F.when(head.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(head))
        .when(head.rlike(r"^\d{4}-\d\d$"), F.try_to_date(F.concat(head, F.lit("-01"))))
        .when(head.rlike(r"^\d{4}-Q[1-4]$"), F.try_to_date(F.concat(year, F.lit("-"), F.lpad((3 * F.substring(head, 7, 1).try_cast("int") - 2).cast("string"), 2, "0"), F.lit("-01"))))
        .when(head.rlike(r"^\d{4}-W\d\d$"), week_start)
        .when(head.rlike(r"^\d{4}$"), F.try_to_date(F.concat(head, F.lit("-01-01"))))
    )
    return label(kind, day)


@dataclass(frozen=True)
class Bucket:
    """A calculation: the label of a date column. Scoped reads turn claimed labels into a range of dates."""

    kind: str
    column: str

    def __call__(self) -> Column:
        return label(self.kind, self.column)
