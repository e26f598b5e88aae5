"""Filters, sorts, numbered views and pages over a table of stored text columns.

Stored tables have ``_ordinal`` and text columns ``c0..``; ``query_view`` adds a typed column ``q0..``
for each.  A query is declared by ``Filter`` and ``Sort`` values; what a column's kind does not
allow is refused before any job starts.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deklara.functions.readings import reading
from deklara.layout import DATE, NUMBER, TEXT, TIME, Layout
from deklara.tables import Sorted, stored_in_order

# The comparisons, and the kinds each is for.
_ANY = {"eq", "ne", "one_of", "empty", "not_empty"}
_ORDERED = _ANY | {"lt", "le", "gt", "ge", "between"}
_TEXTUAL = _ANY | {"contains", "starts_with", "ends_with", "matches"}
COMPARISONS = {TEXT: _TEXTUAL, NUMBER: _ORDERED, DATE: _ORDERED, TIME: _ORDERED}
MAXIMUM_SORTS = 3
GERMAN = "de"


@dataclass(frozen=True)
class Filter:
    """``values`` are canonical: ``1234.5``, ``2025-01-31``, ``14:30:00`` or the text itself.  An open
    bound of ``between`` is None."""

    column: int
    comparison: str
    values: tuple[str | None, ...] = ()
    ignore_case: bool = False


@dataclass(frozen=True)
class Sort:
    column: int
    descending: bool = False


def query_view(stored: DataFrame, layout: Layout, scales: dict[int, int] | None = None) -> DataFrame:
    """All stored columns plus one queryable column for each; nothing is evaluated yet."""
    scales = scales or {}
    return stored.select("*", *(reading(F.col(f"c{i}"), c, layout, scales.get(i)).alias(f"q{i}") for i, c in enumerate(layout.columns)))


def stage(records: DataFrame, layout: Layout, scales: dict[int, int] | None = None) -> DataFrame:
    """Records stored with their queryable columns, each read once, in the order of their ordinals.

    Ordinals of a file are a range of their own, so the statistics of files and row groups let a page or a range of
    records open only what holds it, and filters skip row groups whose values they rule out."""
    return stored_in_order(query_view(records, layout, scales), "_ordinal", "stage")


def _literal(value: str, kind: str) -> Column:
    if kind == NUMBER:
        return F.lit(Decimal(value))
    if kind == DATE:
        return F.lit(value).cast("date")
    if kind == TIME:
        h, m, s = map(int, value.split(":"))
        return F.lit(h * 3600 + m * 60 + s)
    return F.lit(value)


def present(layout: Layout, column: int) -> Column:
    q = F.col(f"q{column}")
    return q != "" if layout.columns[column].query_kind == TEXT else q.isNotNull()


def like_pattern(value: str, before: bool = False, after: bool = False, wild: bool = False) -> str:
    r"""A LIKE pattern for a literal, with ``*`` and ``?`` as wild cards if asked; ``\`` escapes."""
    out = "".join("\\" + ch if ch in "%_\\" else ("%" if ch == "*" else "_") if wild and ch in "*?" else ch for ch in value)
    return ("%" if before else "") + out + ("%" if after else "")


def predicate(layout: Layout, f: Filter) -> Column:
    kind, q, there = layout.columns[f.column].query_kind, F.col(f"q{f.column}"), present(layout, f.column)
    if f.comparison not in COMPARISONS[kind]:
        raise ValueError(f"{f.comparison} is no comparison for a {kind} column")
    if f.comparison == "empty":
        return ~there
    if f.comparison == "not_empty":
        return there
    if f.comparison == "between":
        low, high = f.values
        bounds = [] if low is None else [q >= _literal(low, kind)]
        bounds += [] if high is None else [q <= _literal(high, kind)]
        return reduce(Column.__and__, bounds, there)
    if not f.values or any(v is None for v in f.values):
        raise ValueError(f"{f.comparison} needs a value")
    fold = (lambda c: F.lower(c)) if f.ignore_case and kind == TEXT else (lambda c: c)
    literals = [fold(_literal(v, kind)) for v in f.values]
    if f.comparison == "one_of":
        return there & fold(q).isin(*literals)
    value = f.values[0]
    if f.comparison in ("contains", "starts_with", "ends_with", "matches"):
        pattern = like_pattern(value, f.comparison in ("contains", "ends_with"), f.comparison in ("contains", "starts_with"), f.comparison == "matches")
        return there & (q.ilike(pattern) if f.ignore_case else q.like(pattern))
    compared = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}[f.comparison]
    return there & getattr(fold(q), compared)(literals[0])


def filtered(view: DataFrame, layout: Layout, filters: list[Filter]) -> DataFrame:
    """Rows that pass every filter."""
    return view.where(reduce(Column.__and__, (predicate(layout, f) for f in filters), F.lit(True)))


def order(layout: Layout, sorts: list[Sort]) -> list[Column]:
    """Sort columns: absent last both ways, text in the German alphabet, ties in file order."""
    if len(sorts) > MAXIMUM_SORTS:
        raise ValueError(f"at most {MAXIMUM_SORTS} sort keys")
    keys: list[Column] = []
    for s in sorts:
        q = F.col(f"q{s.column}")
        if layout.columns[s.column].query_kind == TEXT:
            keys.append((q == "").asc())
            q = F.collate(q, GERMAN)
        keys.append(q.desc_nulls_last() if s.descending else q.asc_nulls_last())
    return [*keys, F.col("_ordinal").asc()]


def stored_view(table: DataFrame, layout: Layout, filters: list[Filter] = (), sorts: list[Sort] = ()) -> Sorted:
    """The filtered and sorted rows, stored with the index by which pages find their files; positions count from 0."""
    return Sorted(filtered(table, layout, list(filters)), order(layout, list(sorts)))


def view(table: DataFrame, layout: Layout, filters: list[Filter] = (), sorts: list[Sort] = ()) -> DataFrame:
    """The filtered and sorted rows with their position ``pos`` from 0: a written copy."""
    return stored_view(table, layout, filters, sorts).rows


def page(rows: DataFrame, first: int, count: int, by: str = "pos") -> DataFrame:
    """Rows ``first`` to ``first + count - 1`` by position or ordinal: a range, never an offset."""
    return rows.where(F.col(by).between(first, first + count - 1))


def position_in_view(rows: DataFrame, ordinals: DataFrame) -> DataFrame:
    """For each ordinal its position in a view, -1 if the view does not show it."""
    return ordinals.join(rows.select("_ordinal", "pos"), "_ordinal", "left").select("_ordinal", F.coalesce("pos", F.lit(-1)).alias("pos"))


def lifted(table: DataFrame, layout: Layout, sorts: list[Sort], ordinals: DataFrame) -> DataFrame:
    """Positions of records that a view's filters hide, under the same sort without filters."""
    return position_in_view(view(table, layout, [], sorts), ordinals)


def key_equals(table: DataFrame, columns: list[int], values: list[str], limit: int) -> DataFrame:
    """The first records in file order whose key columns carry exactly these values."""
    same = reduce(Column.__and__, (F.col(f"c{i}") == v for i, v in zip(columns, values, strict=True)))
    return table.where(same).orderBy("_ordinal").limit(limit)


def extent(table: DataFrame) -> DataFrame:
    """First ordinal, number of records, and whether the ordinals have no gap."""
    return table.agg(F.min("_ordinal").alias("first"), F.count("*").alias("records"), F.max("_ordinal").alias("last")).select(
        "first", "records", F.coalesce(F.col("last") - F.col("first") + 1 == F.col("records"), F.lit(True)).alias("contiguous")
    )


def position_counts(table: DataFrame, ordinal: int) -> DataFrame:
    """How many records stand before an ordinal, and whether it is there: positions with gaps."""
    return table.agg(
        F.count_if(F.col("_ordinal") < ordinal).alias("before"), F.count_if(F.col("_ordinal") == ordinal).alias("there")
    )
