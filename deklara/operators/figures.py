"""Exact figures over one or more columns in one pass, and what a column can be asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deklara.functions.readings import number_digits, number_pattern, trimmed
from deklara.layout import DATE, NUMBER, TEXT, TIME, Layout
from deklara.operators.views import present

# The figures each kind has.
_ALWAYS = ("count", "distinct", "missing")
FIGURES = {TEXT: _ALWAYS, NUMBER: (*_ALWAYS, "sum", "min", "max", "avg"), DATE: (*_ALWAYS, "min", "max"), TIME: (*_ALWAYS, "min", "max")}
MAXIMUM_DIGITS = 38


def average(total: Column, n: Column, scale: int) -> Column:
    """total / n rounded half away from zero to ``scale`` places, in whole numbers only."""
    units = F.abs(total) * F.lit(10**scale).cast("decimal(20,0)")
    twice = (2 * units + n).cast("decimal(38,0)")
    quotient = F.floor(twice / (2 * n).cast("decimal(20,0)"))
    value = (quotient.cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(20,0)")).cast(f"decimal(38,{scale})")
    return F.when(total < 0, -value).otherwise(value)


def figures(view: DataFrame, layout: Layout, wanted: list[tuple[int, str]], scale: int = 2) -> DataFrame:
    """One row (column, figure, value, missing, counted, exact) for each figure, from one aggregation.

    Distinct values of several columns are counted apart: rows (column, value) lose their repeats within each task, so the
    shuffle is of distinct values, and no row is carried once for each of the columns.  A sum too wide for 38 digits is no error: its value is null and ``exact`` false, and the other
    figures stand."""
    for i, name in wanted:
        if name not in FIGURES[layout.columns[i].query_kind]:
            raise ValueError(f"{name} is no figure of a {layout.columns[i].query_kind} column")
    apart = sorted({i for i, name in wanted if name == "distinct"})
    apart = apart if len(apart) > 1 else []
    parts: dict[str, Column] = {}
    for i, name in wanted:
        q, there = F.col(f"q{i}"), present(layout, i)
        parts[f"n{i}"], parts[f"m{i}"] = F.count_if(there), F.count_if(~there)
        if name == "distinct" and i not in apart:
            parts[f"distinct{i}"] = F.count_distinct(F.when(there, q))
        elif name in ("sum", "avg"):
            parts[f"sum{i}"] = F.try_sum(q)
        elif name in ("min", "max"):
            parts[f"{name}{i}"] = getattr(F, name)(q)
    row = view.agg(*(c.alias(k) for k, c in parts.items()))
    rows = []
    for i, name in wanted:
        n, m, exact = F.col(f"n{i}"), F.col(f"m{i}"), F.lit(True)
        if name == "count":
            value = n
        elif name == "missing":
            value = m
        elif name == "avg":
            total = F.col(f"sum{i}")
            value, exact = F.when(n > 0, average(total, n, scale)), total.isNotNull() | (n == 0)
        elif name == "distinct" and i in apart:
            value = F.lit(None)
        else:
            value = F.col(f"{name}{i}")
            exact = value.isNotNull() | (n == 0) if name == "sum" else exact
        rows.append(F.struct(F.lit(i).alias("column"), F.lit(name).alias("figure"), value.cast("string").alias("value"), m.alias("missing"), n.alias("counted"), exact.alias("exact")))
    found = row.select(F.explode(F.array(*rows)).alias("f")).select("f.*")
    if not apart:
        return found
    counts = distinct_counts(view, layout, apart)
    value = F.when(F.col("figure") == "distinct", F.coalesce("_n", F.lit(0)).cast("string")).otherwise(F.col("value"))
    return found.join(counts, "column", "left").withColumn("value", value).drop("_n")


def distinct_counts(view: DataFrame, layout: Layout, columns: list[int]) -> DataFrame:
    """(column, _n): how many values each of several columns has, absent ones aside.  A text that stands for a value stands for
    no other of its column."""
    cells = F.array(*(F.when(present(layout, i), F.struct(F.lit(i).alias("column"), F.col(f"q{i}").cast("string").alias("v"))) for i in columns))
    values = view.select(F.explode(F.array_compact(cells)).alias("c")).select("c.*").distinct()
    return values.groupBy("column").agg(F.count("*").alias("_n"))


def _measures(layout: Layout) -> list[Column]:
    """Aggregates of every number column (digits ``w``, decimals ``s``) and time column (unreadable values ``u``)."""
    parts: list[Column] = []
    for i, c in enumerate(layout.columns):
        stored = F.col(f"c{i}")
        if c.query_kind == NUMBER:
            digits = F.when(trimmed(stored).rlike(number_pattern(layout)), number_digits(stored, layout, c))
            parts.append(F.coalesce(F.max(F.length(F.split_part(digits, F.lit("."), F.lit(1)))), F.lit(0)).alias(f"w{i}"))
            parts.append(F.coalesce(F.max(F.length(F.split_part(digits, F.lit("."), F.lit(2)))), F.lit(0)).alias(f"s{i}"))
        elif c.query_kind == TIME:
            parts.append(F.count_if((stored != "") & F.col(f"q{i}").isNull()).alias(f"u{i}"))
    return parts


def measure(view: DataFrame, layout: Layout) -> DataFrame:
    """(column, digits, decimals, unreadable) of the number and time columns, from one pass over the table."""
    rows = []
    for i, c in enumerate(layout.columns):
        if c.query_kind in (NUMBER, TIME):
            number = c.query_kind == NUMBER
            width, scale = (F.col(f"w{i}"), F.col(f"s{i}")) if number else (F.lit(0), F.lit(0))
            rows.append(F.struct(F.lit(c.name).alias("column"), width.alias("digits"), scale.alias("decimals"), (F.lit(0).cast("bigint") if number else F.col(f"u{i}")).alias("unreadable")))
    if not rows:
        return view.limit(0).select(F.lit("").alias("column"), F.lit(0).alias("digits"), F.lit(0).alias("decimals"), F.lit(0).cast("bigint").alias("unreadable"))
    row = view.agg(*_measures(layout), F.count("*").alias("records"))
    return row.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def capabilities(view: DataFrame, layout: Layout) -> DataFrame:
    """(column, kind, scale, unreadable, limitation) of every column, from one pass over the table.

    A number column is measured: the decimals it needs give its scale, and one that needs more than 38
    digits is turned off whole.  A time column counts the values it cannot read."""
    row = view.agg(*_measures(layout), F.count("*").alias("records"))
    rows = []
    for i, c in enumerate(layout.columns):
        scale, unreadable, limit, kind = F.lit(None).cast("int"), F.lit(0).cast("bigint"), F.lit(None).cast("string"), F.lit(c.query_kind)
        if c.query_kind == NUMBER:
            wide = F.col(f"w{i}") + F.col(f"s{i}") > MAXIMUM_DIGITS
            scale, limit, kind = F.when(~wide, F.col(f"s{i}")), F.when(wide, F.lit("too wide")), F.when(wide, F.lit("off")).otherwise(kind)
        elif c.query_kind == TIME:
            unreadable = F.col(f"u{i}")
            limit = F.when(unreadable > 0, F.lit("unreadable values"))
        rows.append(F.struct(F.lit(c.name).alias("column"), kind.alias("kind"), scale.alias("scale"), unreadable.alias("unreadable"), limit.alias("limitation")))
    return row.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def limit_notices(found: DataFrame) -> DataFrame:
    """The columns whose capability is limited."""
    return found.where("limitation is not null").select("column", "limitation", "unreadable")
