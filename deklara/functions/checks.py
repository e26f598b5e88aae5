"""What a stored value must pass: each test is true where the value is at fault.  Empty values never are."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from deklara.functions.readings import date_parts, number_pattern, read_date, trimmed
from deklara.layout import DATE, NUMBER, TEXT, Layout
from deklara.layout import Column as Declared

# Finding codes of the content checks.
TYPE_MISMATCH, TOO_ACCURATE, TOO_LONG, COLUMN_COUNT, UNDECODABLE, UNTERMINATED, RECORD_LENGTH, STOPPED = range(4001, 4009)
HEADER_ORDER, HEADER_UNDECLARED, UNREADABLE = 4009, 4010, 4011
KEY_DUPLICATE, KEY_INCOMPLETE, KEY_UNRESOLVED, KEY_UNCHECKED = range(5001, 5005)


def not_a_number(c: Column, layout: Layout) -> Column:
    return (c != "") & ~trimmed(c).rlike(number_pattern(layout))


def not_a_date(c: Column, column: Declared, layout: Layout) -> Column:
    """A mask without exactly one year, month and day is at fault itself; its values are not tested."""
    if date_parts(column.mask) is None:
        return F.lit(False)
    return (c != "") & read_date(c, column, layout).isNull()


def too_accurate(c: Column, column: Declared, layout: Layout) -> Column:
    """More decimals than declared; a sign behind them is no digit.  Not tested if decimals are implied."""
    if column.implied is not None or column.accuracy is None or not layout.decimal:
        return F.lit(False)
    beyond = rf"{re.escape(layout.decimal)}[0-9]{{{column.accuracy + 1},}}[+-]?\z"
    return (c != "") & trimmed(c).rlike(number_pattern(layout)) & trimmed(c).rlike(beyond)


def too_long(c: Column, column: Declared) -> Column:
    return F.lit(False) if column.max_length is None else F.length(c) > column.max_length


def defects(c: Column, column: Declared, layout: Layout) -> list[tuple[int, Column]]:
    """(code, test) of the tests that the declaration asks of a column."""
    if column.kind == NUMBER:
        found = [(TYPE_MISMATCH, not_a_number(c, layout))]
        return found + ([(TOO_ACCURATE, too_accurate(c, column, layout))] if column.accuracy is not None and column.implied is None else [])
    if column.kind == DATE:
        return [(TYPE_MISMATCH, not_a_date(c, column, layout))]
    return [(TOO_LONG, too_long(c, column))] if column.kind == TEXT and column.max_length is not None else []
