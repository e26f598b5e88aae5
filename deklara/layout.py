"""A table's declaration: what its file looks like and how its values are to be read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TEXT, NUMBER, DATE, TIME = "text", "number", "date", "time"

# The standard's defaults.
DEFAULT_DATE_MASK = "DD.MM.YYYY"
DEFAULT_EPOCH = 30

_TIME_MASK = re.compile(r"HH([^A-Za-z0-9]?)MM(([^A-Za-z0-9]?)SS)?(([^A-Za-z0-9]?)TT)?\Z")


def is_time_mask(mask: str) -> bool:
    return bool(_TIME_MASK.match(mask))


@dataclass(frozen=True)
class Column:
    """One declared column; ``start`` and ``end`` are 1-based character positions of a fixed layout."""

    name: str
    kind: str = TEXT
    max_length: int | None = None
    accuracy: int | None = None
    implied: int | None = None
    mask: str = DEFAULT_DATE_MASK
    maps: tuple[tuple[str, str], ...] = ()
    primary_key: bool = False
    start: int | None = None
    end: int | None = None

    @property
    def time_mask(self) -> str | None:
        """A text column is a time if a map has the same time mask on both sides."""
        return next((a for a, b in self.maps if a == b and is_time_mask(a)), None) if self.kind == TEXT else None

    @property
    def redefinitions(self) -> tuple[tuple[str, str], ...]:
        return tuple((a, b) for a, b in self.maps if a != b)

    @property
    def query_kind(self) -> str:
        return TIME if self.time_mask else self.kind


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    aliases: tuple[tuple[str, str], ...] = ()

    def parent_columns(self, parent_key: tuple[str, ...]) -> tuple[str, ...]:
        """The parent's column for each of ours: by alias if there are aliases, else by place."""
        by_alias = dict(self.aliases)
        return tuple(by_alias.get(c, k) for c, k in zip(self.columns, parent_key, strict=True))


@dataclass(frozen=True)
class Layout:
    name: str
    columns: tuple[Column, ...]
    column_delimiter: str = ";"
    record_delimiter: str = "\r\n"
    encapsulator: str = '"'
    decimal: str = ","
    grouping: str = "."
    epoch: int = DEFAULT_EPOCH
    codepage: str = "ANSI"
    skip_bytes: int = 0
    first_record: int = 1
    last_record: int | None = None
    record_length: int | None = None
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    @property
    def trailing_sign(self) -> bool:
        """A sign may follow the digits unless a declared symbol is itself a sign."""
        return not {self.decimal, self.grouping} & {"+", "-"}

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.primary_key)

    def at(self, name: str) -> int:
        return next(i for i, c in enumerate(self.columns) if c.name == name)
