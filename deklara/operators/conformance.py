"""Conformance of stored records, and findings in a fixed, bounded order.

A finding is a row of ``FINDINGS``.  The passes are column tests, then keys; within a pass the order is
record, then record-level defects before columns from left to right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deklara.functions import checks
from deklara.functions.checks import defects
from deklara.layout import Layout
from deklara.operators import keys
from deklara.tables import numbered, written

COLUMNS = ["code", "severity", "pass", "seq", "table", "_ordinal", "column_index", "column", "value", "expected"]
DEFAULT_BOUND = 50
# Severities by code, where they are not "error".
SEVERITIES = {checks.STOPPED: "info", checks.KEY_UNCHECKED: "warning"}
# Fixed value: how codes of the tool itself begin.
TOOL = "9"
RANKS = {"info": 1, "warning": 2, "error": 3}


def severity(code: int) -> str:
    return SEVERITIES.get(code, "error")


def finding(code: int, table: str | Column, step: int, ordinal: Column, column: int | Column = -1, name: str | Column = "", value: Column | None = None, expected: str | Column = "", seq: int = 0) -> list[Column]:
    """The cells of a finding.  ``expected`` is what was declared; a repeated key's is the list of its records."""
    value = F.lit("") if value is None else value
    cells = [F.lit(str(code)), F.lit(severity(code)), F.lit(step), F.lit(seq), F.lit(table), ordinal.cast("bigint"), F.lit(column), F.lit(name), value, F.lit(expected)]
    return [c.alias(n) for c, n in zip(cells, COLUMNS, strict=True)]


def value_findings(table: DataFrame, layout: Layout) -> DataFrame:
    """The defects of all columns from one scan: a record yields as many rows as it has defects."""
    return _found(table, layout, _value_tests(table, layout))


def record_findings(records: DataFrame, layout: Layout) -> DataFrame:
    """4004-4007 of records as the scans give them: another number of values than declared, bytes that the
    codepage does not know, a capsule that is never closed, a fixed record of another length."""
    return _found(records, layout, _record_tests(records, layout))


def conformance(records: DataFrame, layout: Layout) -> DataFrame:
    """All defects of scanned records, of the record and of its columns, from one scan."""
    return _found(records, layout, _record_tests(records, layout) + _value_tests(records, layout))


def _called(records: DataFrame, layout: Layout) -> str | Column:
    """What the table of each record is called: records of many tables have it with them."""
    return F.col("table") if "table_id" in records.columns else layout.name


def _with_delivery(records: DataFrame) -> list[str]:
    return ["delivery"] if "table_id" in records.columns else []


def _value_tests(records: DataFrame, layout: Layout) -> list[Column]:
    found = []
    name = _called(records, layout)
    for i, c in enumerate(layout.columns):
        for code, test in defects(F.col(f"c{i}"), c, layout):
            cells = F.struct(*finding(code, name, 1, F.col("_ordinal"), i, c.name, F.col(f"c{i}"), expected_of(c, code)))
            found.append(F.when(test, cells))
    return found


def _record_tests(records: DataFrame, layout: Layout) -> list[Column]:
    n, at, there, table = len(layout.columns), F.col("_ordinal"), set(records.columns), _called(records, layout)
    names = F.array(*(F.lit(c.name) for c in layout.columns))
    named = lambda i: F.coalesce(F.get(names, i), F.lit(""))
    odd = F.array_position(F.array(*(F.contains(f"c{i}", F.lit("\ufffd")) for i in range(n))), True).cast("int") - 1
    tests = [(odd >= 0, finding(checks.UNDECODABLE, table, 1, at, odd, named(odd), expected=layout.codepage))]
    if "n_values" in there:
        given = F.col("n_values")
        tests.append((given != n, finding(checks.COLUMN_COUNT, table, 1, at, value=given.cast("string"), expected=str(n))))
    if "unterminated" in there:
        last = F.col("n_values") - 1
        tests.append((F.col("unterminated"), finding(checks.UNTERMINATED, table, 1, at, last, named(last), expected=layout.encapsulator)))
    if "n_chars" in there:
        given = F.col("n_chars")
        tests.append((given != layout.record_length, finding(checks.RECORD_LENGTH, table, 1, at, value=given.cast("string"), expected=str(layout.record_length))))
    return [F.when(test, F.struct(*cells)) for test, cells in tests]


def _found(table: DataFrame, layout: Layout, found: list[Column]) -> DataFrame:
    if not found:
        return table.limit(0).select(*_with_delivery(table), *finding(checks.TYPE_MISMATCH, _called(table, layout), 1, F.col("_ordinal")))
    # Most records have no defect.  They are left out first, for what makes the rows of findings is not compiled.
    table = table.where(reduce(Column.__or__, (f.isNotNull() for f in found)))
    return table.select(*_with_delivery(table), F.explode(F.array_compact(F.array(*found))).alias("f")).select(*_with_delivery(table), "f.*")


def permuted(names: Column, others: Column) -> Column:
    """Whether two arrays hold the same names, each as often, in another order."""
    return (F.sort_array(names) == F.sort_array(others)) & (names != others)


def header_findings(records: DataFrame, layout: Layout) -> DataFrame:
    """4009: the first record is no data and holds the declared names in another order.  4010: it holds them in
    any order and counts as data.  ``records`` are all of the file's, whatever range is declared."""
    names = F.array(*(F.lit(c.name) for c in layout.columns))
    given = F.array(*(F.btrim(F.col(f"c{i}")) for i in range(len(layout.columns))))
    first = records.where((F.col("_ordinal") == 1) & (F.col("n_values") == len(layout.columns)))
    shown, table, who = F.array_join(given, ", "), _called(records, layout), _with_delivery(records)
    if layout.first_record <= 1:
        cells = finding(checks.HEADER_UNDECLARED, table, 0, F.col("_ordinal"), value=shown)
        return first.where((names == given) | permuted(names, given)).select(*who, *cells)
    cells = finding(checks.HEADER_ORDER, table, 0, F.col("_ordinal"), value=shown, expected=F.array_join(names, ", "))
    return first.where(permuted(names, given)).select(*who, *cells)


def unreadable_findings(tables: DataFrame) -> DataFrame:
    """4011 for each table (table, url, reason; with delivery, if it is there) whose declaration gives no reading:
    where ``reason`` is there."""
    bad = tables.where("reason is not null")
    return bad.select(*(c for c in ("delivery",) if c in tables.columns), *finding(checks.UNREADABLE, F.col("table"), 0, F.lit(None), value=F.col("url"), expected=F.col("reason")))


def expected_of(column, code: int) -> str:
    """What a finding says was declared."""
    if code == checks.TOO_ACCURATE:
        return str(column.accuracy)
    if code == checks.TOO_LONG:
        return str(column.max_length)
    return column.mask if column.kind == "date" else column.kind


def minimal_quotes(findings: DataFrame, records: DataFrame, layout: Layout) -> DataFrame:
    """Findings of columns with ``only``: whether each quotes the value at fault, and no other of its record."""
    cells = records.select("_ordinal", F.array(*(F.col(f"c{i}") for i in range(len(layout.columns)))).alias("_cells"))
    quoted = findings.where("column_index >= 0").join(cells, "_ordinal", "left")
    return quoted.withColumn("only", F.coalesce(F.col("value") == F.get("_cells", F.col("column_index")), F.lit(False))).drop("_cells")


def key_findings(rows: DataFrame, code: int, layout: Layout, ordinal: str, value: Column, seq: int = 0) -> DataFrame:
    return rows.select(*finding(code, layout.name, 2, F.col(ordinal), value=value, seq=seq))


def incomplete_key_findings(table: DataFrame, key: list[str], layout: Layout) -> DataFrame:
    """5002 for each record whose key has an empty part."""
    return key_findings(keys.incomplete(table, key), checks.KEY_INCOMPLETE, layout, "_ordinal", keys.quoted(key))


def duplicate_key_findings(table: DataFrame, key: list[str], layout: Layout) -> DataFrame:
    """5001 for each repeated key, at its first record, with the list of its records (lists of at most 10,000)."""
    rows = keys.duplicates(table, key)
    return rows.select(*finding(checks.KEY_DUPLICATE, layout.name, 2, F.col("first"), value=F.col("key"), expected=F.col("records"), seq=1))


def reference_findings(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str], layout: Layout, parent_name: str, seq: int = 2) -> DataFrame:
    """5003 for each record whose reference names no record of the parent."""
    lost = keys.unresolved(child, columns, parent, key)
    return lost.select(*finding(checks.KEY_UNRESOLVED, layout.name, 2, F.col("_ordinal"), value=keys.quoted(columns), expected=parent_name, seq=seq))


def key_value_findings(values: DataFrame, most: int = 10_000) -> list[DataFrame]:
    """5001, 5002 and 5003 of the key values of all tables (``keys.key_values``), with their delivery.

    All keys and references go through one aggregation, which adds up within tasks first, so a key that a third of the records
    refer to is a few rows of the shuffle.  It leaves the keys that are at fault; records are joined with those alone."""
    own, whole = F.col("fk") == -1, ~F.array_contains("key", "")
    key = ["delivery", "target_id", "key"]
    judged = values.groupBy(*key).agg(
        F.count_if(own & whole).alias("n"), F.count_if(~own).alias("references"), F.min(F.when(own, F.col("_ordinal"))).alias("first")
    )
    judged = written(judged.where("n > 1 or (n = 0 and references > 0)").select(*key, "n", "first"), "keys-at-fault")
    quoted_key = F.array_join("key", "|")
    partial = values.where(own & ~whole)
    repeated = judged.where("n > 1")
    rows = values.where(own & whole).select(*key, "table", F.col("_ordinal").alias("_record")).join(repeated, key)
    lists = keys.listed(rows, repeated, [*key, "table"], most)
    lost = values.where(~own).join(judged.where("n = 0"), key)
    return [
        partial.select("delivery", *finding(checks.KEY_INCOMPLETE, F.col("table"), 2, F.col("_ordinal"), value=quoted_key)),
        lists.select("delivery", *finding(checks.KEY_DUPLICATE, F.col("table"), 2, F.col("first"), value=quoted_key, expected=F.col("records"), seq=1)),
        lost.select("delivery", *finding(checks.KEY_UNRESOLVED, F.col("table"), 2, F.col("_ordinal"), value=quoted_key, expected=F.col("target"), seq=2)),
    ]


def unchecked_findings(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """5004 for each reference into a table that could not be read, with the delivery."""
    rows = keys.unchecked(fks, tables)
    return rows.select("delivery", *finding(checks.KEY_UNCHECKED, F.col("table"), 2, F.lit(None), value=F.col("parent"), seq=2))


def union(parts: list[DataFrame]) -> DataFrame:
    """The findings of several passes."""
    return reduce(DataFrame.unionByName, parts)


ORDER = ["pass", "seq", "_ordinal", "column_index", "code"]


def bounded(findings: DataFrame, bound: int = DEFAULT_BOUND) -> DataFrame:
    """The first ``bound`` findings of each table, numbered from 1, and one notice behind them if there
    are more.

    The window carries its rank limit, so each task keeps ``bound + 1`` rows of a table before the
    shuffle and no task sees a table's findings whole."""
    who = [c for c in ("delivery",) if c in findings.columns]
    place = F.row_number().over(Window.partitionBy(*who, "table").orderBy(*ORDER))
    first = findings.withColumn("place", place).where(F.col("place") <= bound + 1)
    stopped = [F.lit(str(checks.STOPPED)), F.lit("info"), F.lit(9), F.lit(0), F.col("table"), F.lit(None).cast("bigint"), F.lit(-1), F.lit(""), F.lit(""), F.lit(str(bound))]
    over = first.where(F.col("place") > bound)
    notice = over.select(*who, *(c.alias(n) for c, n in zip(stopped, COLUMNS, strict=True)), "place")
    return first.where(F.col("place") <= bound).unionByName(notice)


def first_defects(findings: DataFrame, bound: int) -> DataFrame:
    """The first ``bound + 1`` findings of one table."""
    return findings.orderBy(*ORDER).limit(bound + 1)


def verdicts(findings: DataFrame, deliveries: DataFrame, strict: bool = False) -> DataFrame:
    """Errors, warnings, notes and the verdict of each delivery, those without findings included."""
    every = deliveries.select("delivery").distinct().join(findings, "delivery", "left")
    return _counted(every.groupBy("delivery"), strict)


def counts(findings: DataFrame, strict: bool = False) -> DataFrame:
    """Errors, warnings, notes and the verdict: one row."""
    return _counted(findings.groupBy(), strict)


def _counted(findings, strict: bool) -> DataFrame:
    row = findings.agg(*(F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "notes"))))
    bad = (F.col("errors") > 0) | (F.col("warnings") > 0) if strict else F.col("errors") > 0
    return row.select("*", F.when(bad, "not conformant").otherwise("conformant").alias("verdict"), (F.col("errors") + F.col("warnings") + F.col("notes") == 0).alias("clean"))


def exit_class(findings: DataFrame, strict: bool = False) -> DataFrame:
    """0 conformant, 1 warnings, 2 errors (of a strict run: warnings too), 3 the tool failed; the worst decides."""
    error = F.col("severity") == "error"
    rank = F.when(error & F.col("code").startswith(TOOL), 3).when(error, 2).when(F.col("severity") == "warning", 2 if strict else 1).otherwise(0)
    return findings.agg(F.coalesce(F.max(rank), F.lit(0)).alias("exit_class"))


def table_state(findings: DataFrame, records: DataFrame, bound: int = DEFAULT_BOUND) -> DataFrame:
    """Per table: records, findings, whether it conforms, whether its findings are more than shown."""
    per = findings.groupBy("table").agg(F.count("*").alias("findings"))
    n = F.coalesce("findings", F.lit(0))
    return records.join(per, "table", "left").select("table", "records", n.alias("findings"), (n == 0).alias("conforms"), (n > bound).alias("truncated"))


def report_order(findings: DataFrame) -> DataFrame:
    """Findings with their place in a report: groups without a table first, then by worst severity
    and name; within a group by severity, code, record and column."""
    ranks = F.create_map(*(F.lit(v) for pair in RANKS.items() for v in pair))
    rank = ranks[F.col("severity")]
    worst = findings.groupBy("table").agg(F.max(rank).alias("worst"))
    joined = findings.join(worst, "table")
    keys = [(F.col("table") != "").asc(), F.desc("worst"), F.asc("table"), rank.desc(), F.asc("code"), F.asc("_ordinal"), F.asc("column_index")]
    return numbered(joined, keys, "place", 1).drop("worst")
