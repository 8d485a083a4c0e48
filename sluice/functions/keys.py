"""Keys, units, fingerprints and basis digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = "*"
BAR = "|"
# Fixed values of version 1 of the basis digest; the separator is these four characters, not one byte.
BASIS_SEPARATOR = "\\x1F"
BASIS_VERSION = 1
BASIS_UNKNOWN = "unknown-basis-version"


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def key_of(columns: Iterable[Column | str], prefix: str | None = None) -> Column:
    """The columns' values as strings, joined by bars; null is empty."""
    parts = [F.coalesce(_text(c), F.lit("")) for c in columns]
    return F.concat_ws(BAR, *([F.lit(prefix)] if prefix else []), *parts)


def identity_of(columns: Iterable[Column | str], prefix: str | None = None) -> Column:
    """The hidden key and unit: like ``key_of``, but different values never have the same one.

    Null is a backslash and N, a backslash is doubled, and a bar inside one of several values has a backslash before it.
    """
    columns = list(columns)
    parts = [F.replace(_text(c), F.lit("\\"), F.lit("\\\\")) for c in columns]
    parts = [F.coalesce(F.replace(p, F.lit(BAR), F.lit("\\" + BAR)) if len(columns) > 1 else p, F.lit("\\N")) for p in parts]
    return F.concat_ws(BAR, *([F.lit(prefix)] if prefix else []), *parts)


def value_of(key: str) -> str | None:
    """The value that a hidden key of one column stands for."""
    return None if key == "\\N" else key.replace("\\\\", "\\")


def first_segment(key: Column) -> Column:
    """The first value of a hidden key."""
    head = F.regexp_extract(key, r"^((?:[^\\|]|\\.)*)", 1)
    return F.when(head != "\\N", F.regexp_replace(head, r"\\(.)", "$1"))


def fingerprint(fields: Iterable[str] | Callable[[], Column] | None) -> Column | None:
    """A digest of the fields' values in their order, in which null and empty differ; None for no fields."""
    if callable(fields):
        return fields().cast("string")
    fields = list(fields or ())
    if not fields:
        return None
    return F.sha2(F.to_json(F.struct(*(F.col(f).alias(f"f{i}") for i, f in enumerate(fields))), {"ignoreNullFields": "false"}), 256)


def basis_column(fields: list[str]) -> Column:
    """Aggregate: the versioned digest of a set of rows, whatever their order.

    Rows are sorted as lists of fields, not as joined strings. This version digests them all in one piece, so a group's rows must fit in a task.
    """
    rows = F.sort_array(F.collect_list(F.array(*(F.coalesce(_text(f), F.lit("")) for f in fields))))
    lines = F.transform(rows, lambda row: F.array_join(row, BASIS_SEPARATOR))
    return F.concat(F.lit(f"{BASIS_VERSION}:"), F.sha2(F.array_join(lines, "\n"), 256))


def basis(rows: Iterable[Mapping] | DataFrame, fields: list[str], version: int = BASIS_VERSION) -> str:
    """The digest of a row set: of a DataFrame by one aggregation, of plain rows in Python."""
    if version != BASIS_VERSION:
        return BASIS_UNKNOWN
    if isinstance(rows, DataFrame):
        missing = [f for f in fields if f not in rows.columns]
        if missing:
            raise KeyError(missing[0])
        return rows.agg(basis_column(fields)).first()[0]
    lines = sorted([_plain(r[f]) for f in fields] for r in rows)
    return f"{BASIS_VERSION}:" + hashlib.sha256("\n".join(BASIS_SEPARATOR.join(x) for x in lines).encode()).hexdigest()


def _plain(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def basis_version(digest: str | None) -> int:
    head = (digest or "").partition(":")[0]
    return int(head) if ":" in (digest or "") and head.isdigit() else 0


def basis_matches(digest: str | None, rows, fields: list[str]) -> bool:
    """Whether rows still have a stored digest, under the version it was made with."""
    version = basis_version(digest)
    return version == BASIS_VERSION and basis(rows, fields, version) == digest
