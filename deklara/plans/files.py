"""Queries over declared files: the tables are written as deliveries and read back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from deklara.functions import checks as K
from deklara.layout import Column, Layout
from deklara.operators import conformance as N
from deklara.operators import views as V
from deklara.plans import fixtures as X
from deklara.plans.registry import query
from deklara.sources import scan as S
from deklara.sources import sinks
from deklara.tables import scratch

ORDERS = replace(X.ORDERS, codepage="UTF8")
PLAIN = Layout("Plain", (Column("Order"), Column("Customer"), Column("Note")), codepage="UTF8")


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def _write(rows, path, files=None):
    """Files whose names and lines are in record order, one from each task."""
    parts = rows.repartitionByRange(files, "_ordinal") if files else rows.repartitionByRange("_ordinal")
    parts.sortWithinPartitions("_ordinal").select("value").write.option("lineSep", "\r\n").text(path)


def _write_one(rows, path, sep):
    """One file in record order.  Its one task gets rows of up to 4,096 lines that other tasks have put together."""
    lines = F.sort_array(F.collect_list(F.struct("_ordinal", "value")))
    chunks = rows.groupBy(F.floor(F.col("_ordinal") / 4096).alias("chunk")).agg(F.array_join(lines["value"], sep).alias("value"))
    chunks.repartitionByRange(1, "chunk").sortWithinPartitions("chunk").select("value").write.option("lineSep", sep).text(path)


def orders_file(spark, sf_dir):
    """All columns encapsulated; every third record has a note over two lines with delimiters."""
    k = F.col("_ordinal")
    note = F.when(k % 3 == 0, F.concat(F.lit('say "x";\r\nand '), F.col("c5"))).otherwise(F.col("c5"))
    rows = X.orders_text(spark, sf_dir).select("_ordinal", F.concat_ws(";", F.col("c0"), _quoted(F.col("c1")), _quoted(note)).alias("value"))
    path = scratch(spark, "file")
    _write(rows, path)
    return path


_NOTE = "case when (o_orderkey + 1) % 3 = 0 then 'say \"x\";' || chr(13) || chr(10) || 'and ' || o_orderpriority else o_orderpriority end"
_SCAN = f"select o_orderkey + 1 as _ordinal, o_orderkey::varchar as c0, o_custkey::varchar as c1, {_NOTE} as c2 from orders"


@query("scan_delimited", _SCAN)
def scan_delimited(spark, sf_dir):
    return S.scan_delimited(spark, orders_file(spark, sf_dir), PLAIN).select("_ordinal", "c0", "c1", "c2")


@query("stitch_records", "select o_orderkey + 1 as _ordinal, (o_orderkey + 1) % 3 = 0 as several from orders")
def stitch_records(spark, sf_dir):
    raw = S.lines(spark, orders_file(spark, sf_dir), PLAIN)
    return S.stitched(S.numbered_lines(raw, PLAIN), PLAIN).select("_ordinal", F.contains("value", F.lit("\r\n")).alias("several"))


@query("record_number", "select o_orderkey + 1 as _ordinal, o_orderkey::varchar as c0 from orders")
def record_number(spark, sf_dir):
    return S.scan_delimited(spark, orders_file(spark, sf_dir), PLAIN).select("_ordinal", "c0")


@query("record_range", _SCAN + " where o_orderkey + 1 between 100 and 5000")
def record_range(spark, sf_dir):
    return S.scan_delimited(spark, orders_file(spark, sf_dir), replace(PLAIN, first_record=100, last_record=5000)).select("_ordinal", "c0", "c1", "c2")


def _ragged(spark, sf_dir):
    k, parts = F.col("_ordinal"), F.array("c0", "c1", "c4", "c5")
    rows = X.orders_text(spark, sf_dir).select("_ordinal", F.array_join(F.slice(parts, 1, (k % 4 + 1).cast("int")), ";").alias("value"))
    path = scratch(spark, "file")
    _write(rows, path)
    return S.scan_delimited(spark, path, PLAIN)


@query("shape_to_declared", "select o_orderkey + 1 as _ordinal, o_orderkey::varchar as c0, case when (o_orderkey + 1) % 4 >= 1 then o_custkey::varchar else '' end as c1, case when (o_orderkey + 1) % 4 >= 2 then o_orderstatus else '' end as c2 from orders")
def shape_to_declared(spark, sf_dir):
    return _ragged(spark, sf_dir).select("_ordinal", "c0", "c1", "c2")


def _told(found, code):
    """The findings of one code."""
    return found.where(F.col("code") == str(code)).select("code", "severity", "table", "_ordinal", "column_index", "column", "value", "expected")


def _finding_sql(code, ordinal, rest, column_index="-1", column="''", value="''", expected="''", table="Plain"):
    """A finding as SQL."""
    return f"select '{code}' as code, 'error' as severity, '{table}' as \"table\", {ordinal} as _ordinal, {column_index} as column_index, {column} as \"column\", {value} as value, {expected} as expected from {rest}"


_AT = "o_orderkey + 1"


@query("check_column_count", _finding_sql(4004, _AT, f"orders where ({_AT}) % 4 <> 2", value=f"(({_AT}) % 4 + 1)::varchar", expected="'3'"))
def check_column_count(spark, sf_dir):
    return _told(N.record_findings(_ragged(spark, sf_dir), PLAIN), K.COLUMN_COUNT)


@query("stage_table", _SCAN)
def stage_table(spark, sf_dir):
    path = scratch(spark, "stage")
    S.scan_delimited(spark, orders_file(spark, sf_dir), PLAIN).select("_ordinal", "c0", "c1", "c2").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


FIXED = Layout("Fixed", (Column("Order", start=1, end=8), Column("Status", start=9, end=9), Column("Priority", start=10, end=24)), codepage="UTF8", record_length=24)


def _fixed(spark, sf_dir):
    k = F.col("_ordinal")
    value = F.concat(F.rpad("c0", 8, " "), F.col("c4"), F.rpad("c5", 15, "."))
    rows = X.orders_text(spark, sf_dir).select("_ordinal", F.when(k % 50 == 0, F.left(value, F.lit(12))).otherwise(value).alias("value"))
    path = scratch(spark, "file")
    _write(rows, path)
    return S.scan_fixed(spark, path, FIXED)


@query("scan_fixed", "select o_orderkey + 1 as _ordinal, rpad(o_orderkey::varchar, 8, ' ') as c0, o_orderstatus as c1, case when (o_orderkey + 1) % 50 = 0 then left(rpad(o_orderpriority, 15, '.'), 3) else rpad(o_orderpriority, 15, '.') end as c2 from orders")
def scan_fixed(spark, sf_dir):
    return _fixed(spark, sf_dir).select("_ordinal", "c0", "c1", "c2")


@query("check_record_length", _finding_sql(4007, _AT, f"orders where ({_AT}) % 50 = 0", value="'12'", expected="'24'", table="Fixed"))
def check_record_length(spark, sf_dir):
    return _told(N.record_findings(_fixed(spark, sf_dir), FIXED), K.RECORD_LENGTH)


_BARE = replace(FIXED, record_delimiter="", record_length=25)
_BARE_SQL = "select {at} as _ordinal, rpad(o_orderkey::varchar, 8, '#') as c0, case when o_orderkey % 3 = 0 then 'ß' else o_orderstatus end as c1, rpad(o_orderpriority, 15, chr(10)) as c2 from orders"


def _undelimited(spark, sf_dir, codepage, files=5, tail=""):
    """Orders as records of 25 characters that nothing but their length cuts, in several files; line feeds are among the
    characters.  ``tail`` is an unfinished record behind the last."""
    rows = X.orders_text(spark, sf_dir)
    status = F.when(F.col("c0").cast("bigint") % 3 == 0, "ß").otherwise(F.col("c4"))
    text = F.concat(F.rpad("c0", 8, "#"), status, F.rpad("c5", 15, "\n"))
    rows = rows.select("_ordinal", (text if codepage == "UTF8" else S.encoded(text, codepage).cast("string")).alias("value"))
    if tail:
        rows = rows.unionByName(spark.range(1).select(F.lit(1 << 60).alias("_ordinal"), F.lit(tail).alias("value")))
    path = scratch(spark, "file")
    if files == 1:
        _write_one(rows, path, "\n")
    else:
        rows.repartitionByRange(files, "_ordinal").sortWithinPartitions("_ordinal").select("value").write.option("lineSep", "\n").text(path)
    return S.scan_fixed(spark, path, replace(_BARE, codepage=codepage))


@query("scan_fixed_undelimited", " union all ".join(f"select '{c}' as codepage, * from ({_BARE_SQL.format(at='o_orderkey + 1')})" for c in ("UTF8", "ANSI")))
def scan_fixed_undelimited(spark, sf_dir):
    """The same records with characters of several bytes, counted, and of one byte, read by their place.  The line feed
    that ends each is its last character, and no column's."""
    found = [_undelimited(spark, sf_dir, codepage).select(F.lit(codepage).alias("codepage"), "_ordinal", "c0", "c1", "c2") for codepage in ("UTF8", "ANSI")]
    return N.union(found)


@query("check_record_length_undelimited", _finding_sql(4007, "max(o_orderkey) + 2", "orders", value="'3'", expected="'25'", table="Fixed"))
def check_record_length_undelimited(spark, sf_dir):
    """The file ends in three characters of a record, of which a line feed is the last."""
    return _told(N.record_findings(_undelimited(spark, sf_dir, "UTF8", 1, "xy"), replace(_BARE, codepage="UTF8")), K.RECORD_LENGTH)


# The words of a file of parts, with umlauts that each codepage writes otherwise.
_WORD = "Größe"


def _encoded(spark, sf_dir, codepage):
    """Parts as a file of one codepage, umlauts included."""
    words = V.query_view(X.part_text(spark, sf_dir), X.PARTS)
    text = F.concat_ws(";", "c0", "q2", F.lit(_WORD))
    path = scratch(spark, "file")
    if codepage == "UTF16":
        parts = words.repartitionByRange("_ordinal").sortWithinPartitions("_ordinal")
        parts.select(F.encode(text, "UTF-16LE").cast("string").alias("value")).write.option("lineSep", "\r\0\n\0").text(path)
    else:
        _write(words.select("_ordinal", S.encoded(text, codepage).cast("string").alias("value")), path)
    return path


@query("scan_codepage", f"with {X.PARTS_SQL} select codepage, _ordinal, c0, q2 as c1, '{_WORD}' as c2 from p, (values ('ANSI'), ('OEM'), ('Macintosh'), ('UTF16')) v(codepage)")
def scan_codepage(spark, sf_dir):
    """The same parts from a file of each codepage."""
    found = []
    for codepage in ("ANSI", "OEM", "Macintosh", "UTF16"):
        rows = S.scan_delimited(spark, _encoded(spark, sf_dir, codepage), replace(PLAIN, codepage=codepage))
        found.append(rows.select(F.lit(codepage).alias("codepage"), "_ordinal", "c0", "c1", "c2"))
    return N.union(found)


@query("check_undecodable", f"with {X.PARTS_SQL} " + _finding_sql(4005, "_ordinal", "p", "case when q2 = 'Groß' then 1 else 2 end", "case when q2 = 'Groß' then 'Customer' else 'Note' end", expected="'UTF8'"))
def check_undecodable(spark, sf_dir):
    """A file of one codepage read as UTF-8: the first column with a replacement character."""
    return _told(N.record_findings(S.scan_delimited(spark, _encoded(spark, sf_dir, "ANSI"), PLAIN), PLAIN), K.UNDECODABLE)


@query(
    "check_undecodable_utf16",
    f"with {X.PARTS_SQL} select _ordinal, case when p_partkey % 7 = 0 then c0 || chr(65533) else c0 end as c0, case when p_partkey % 5 = 0 then chr(65533) || q2 || chr(128512) else q2 end as c1,"
    " case when p_partkey % 7 = 0 then 0 when p_partkey % 5 = 0 then 1 end as column_index from p join part on p_partkey = c0::bigint",
)
def check_undecodable_utf16(spark, sf_dir):
    """A UTF-16 file in which halves of surrogate pairs stand alone: they are replaced, reported, and nothing else is lost."""
    words = V.query_view(X.part_text(spark, sf_dir), X.PARTS)
    k, wide = F.col("c0").cast("bigint"), lambda c: F.encode(c, "UTF-16LE")
    half = lambda test, code: F.when(test, F.unhex(F.lit(code))).otherwise(F.lit(b""))
    whole = F.when(k % 5 == 0, wide(F.lit("😀"))).otherwise(F.lit(b""))
    value = F.concat(wide(F.col("c0")), half(k % 7 == 0, "00D8"), wide(F.lit(";")), half(k % 5 == 0, "00DC"), wide(F.col("q2")), whole, wide(F.lit(";ßØ")))
    path = scratch(spark, "file")
    parts = words.repartitionByRange("_ordinal").sortWithinPartitions("_ordinal")
    parts.select(value.cast("string").alias("value")).write.option("lineSep", "\r\0\n\0").text(path)
    layout = replace(PLAIN, codepage="UTF16")
    read = S.scan_delimited(spark, path, layout)
    found = N.record_findings(read, layout).where(F.col("code") == str(K.UNDECODABLE)).select("_ordinal", "column_index")
    return read.select("_ordinal", "c0", "c1").join(found, "_ordinal", "left")


@query("scan_bom", "select o_orderkey + 1 as _ordinal, o_orderkey::varchar as c0 from orders")
def scan_bom(spark, sf_dir):
    """Every record of a file that begins with a mark."""
    first = F.when(F.col("_ordinal") == 1, "﻿").otherwise("")
    rows = X.orders_text(spark, sf_dir).select("_ordinal", F.concat(first, F.concat_ws(";", "c0", "c1", "c5")).alias("value"))
    path = scratch(spark, "file")
    _write(rows, path)
    return S.scan_delimited(spark, path, PLAIN).select("_ordinal", "c0")


@query("scan_skip_bytes", "select o_orderkey + 1 as _ordinal, o_orderkey::varchar as c0, o_custkey::varchar as c1 from orders")
def scan_skip_bytes(spark, sf_dir):
    """Many files, each behind six bytes that are no record; every third note holds delimiters."""
    k = F.col("_ordinal")
    note = F.when(k % 3 == 0, F.concat(F.lit('say "x";\r\nand '), F.col("c5"))).otherwise(F.col("c5"))
    rows = X.orders_text(spark, sf_dir).select("_ordinal", F.concat_ws(";", "c0", "c1", _quoted(note)).alias("value"))
    path = scratch(spark, "file")
    parts = rows.repartitionByRange(8, "_ordinal").sortWithinPartitions("_ordinal")
    opens = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # a task's first row
    parts.select(F.concat(F.when(opens, "#HEAD#").otherwise(""), "value").alias("value")).write.option("lineSep", "\r\n").text(path)
    return S.scan_delimited(spark, path, replace(PLAIN, skip_bytes=6)).select("_ordinal", "c0", "c1")


@query("check_unterminated", _finding_sql(4006, "max(o_orderkey) + 1", "orders", "2", "'Note'", expected="'\"'"))
def check_unterminated(spark, sf_dir):
    """The last record opens a capsule that the file never closes."""
    rows = X.orders_text(spark, sf_dir)
    last = rows.agg(F.max("_ordinal").alias("last"))
    open_ = F.when(F.col("_ordinal") == F.col("last"), F.concat(F.lit('"'), F.col("c5"))).otherwise(F.col("c5"))
    path = scratch(spark, "file")
    _write(rows.crossJoin(F.broadcast(last)).select("_ordinal", F.concat_ws(";", F.col("c0"), F.col("c1"), open_).alias("value")), path)
    return _told(N.record_findings(S.scan_delimited(spark, path, PLAIN), PLAIN), K.UNTERMINATED)


@query(
    "stitch_bounded",
    "with t as (select max(o_orderkey) + 1 as last, sum(length(o_orderkey::varchar || ';' || o_custkey::varchar || ';' || o_orderpriority) + 2) + 1 as size from orders)"
    " select 1 as _ordinal, true as cut, true as unterminated, 2 as n_values, (select size from t) as chars, true as bounded",
)
def stitch_bounded(spark, sf_dir):
    """A capsule opened in the first record is never closed: one record holds the whole file, in parts of bounded size."""
    rows = X.orders_text(spark, sf_dir)
    rest = F.concat(F.when(F.col("_ordinal") == 1, F.lit('"')).otherwise(F.lit("")), F.col("c1"), F.lit(";"), F.col("c5"))
    path, most = scratch(spark, "file"), 20_000
    _write_one(rows.select("_ordinal", F.concat("c0", F.lit(";"), rest).alias("value")), path, "\r\n")
    numbered = S.numbered_lines(S.lines(spark, path, PLAIN), PLAIN)
    record = S.scan_delimited(spark, path, PLAIN, most=most).select("_ordinal", "cut", "unterminated", "n_values")
    length = F.length("value")
    parts = S.record_parts(numbered, PLAIN, most).groupBy("_ordinal").agg(F.sum(length).alias("chars"), (F.max(length) <= most + 100).alias("bounded"))
    return record.join(parts, "_ordinal")


def _with_header(spark, sf_dir, names):
    head = spark.range(1).select(F.lit(0).cast("bigint").alias("_ordinal"), F.lit(";".join(names)).alias("value"))
    rows = X.orders_text(spark, sf_dir).select("_ordinal", F.concat_ws(";", "c0", "c1", "c5").alias("value"))
    path = scratch(spark, "file")
    _write(head.unionAll(rows), path)
    return S.scan_delimited(spark, path, PLAIN)


_SOME = "(select count(*) as n from orders) where n > 0"


@query("check_header_order", _finding_sql(4009, "1", _SOME, value="'Customer, Order, Note'", expected="'Order, Customer, Note'"))
def check_header_order(spark, sf_dir):
    """The first record is declared to be no data, and names the columns in another order."""
    return _told(N.header_findings(_with_header(spark, sf_dir, ["Customer", "Order", "Note"]), replace(PLAIN, first_record=2)), K.HEADER_ORDER)


@query("check_header_undeclared", _finding_sql(4010, "1", _SOME, value="'Order, Customer, Note'"))
def check_header_undeclared(spark, sf_dir):
    return _told(N.header_findings(_with_header(spark, sf_dir, ["Order", "Customer", "Note"]), PLAIN), K.HEADER_UNDECLARED)


@query("header_permutation", "select p_partkey, list_sort(string_split(p_name, ' ')) = list_sort(string_split(p_type || ' ' || p_name, ' ')) or (len(string_split(p_name, ' ')) > 1 and list_reverse(string_split(p_name, ' ')) <> string_split(p_name, ' ')) as permuted from part")
def header_permutation(spark, sf_dir):
    """The words of each part's name against the same words backwards, and against one word more."""
    words = F.split("p_name", " ")
    back, more = F.reverse(words), F.concat(F.array("p_type"), words)
    return X.load(spark, sf_dir, "part").select("p_partkey", (N.permuted(words, back) | N.permuted(words, more)).alias("permuted"))


@query("list_entries")
def list_entries(spark, sf_dir):
    """The table's own files; lengths only."""
    return S.entries(spark, f"{sf_dir}/orders.parquet").select("name", "length")


def _report(spark, sf_dir):
    return N.value_findings(X.orders_defective(spark, sf_dir), X.ORDERS)


@query("sink_findings_json", f"with {X.DEFECTIVE_SQL} select code, _ordinal, value from f union all select 'verdict', NULL, 'not conformant' union all select 'errors', NULL, count(*)::varchar from f union all select 'schema', NULL, '1'")
def sink_findings_json(spark, sf_dir):
    """The findings, and what the report's head says: its cells as rows."""
    path = scratch(spark, "json")
    sinks.json_report(_report(spark, sf_dir), path)
    found = spark.read.schema("code string, _ordinal bigint, value string").json(f"{path}/findings")
    head = spark.read.schema("schemaVersion int, verdict string, counts struct<error: bigint>").json(f"{path}/report")
    cells = F.create_map(F.lit("verdict"), F.col("verdict"), F.lit("errors"), F.col("counts.error").cast("string"), F.lit("schema"), F.col("schemaVersion").cast("string"))
    told = head.select(F.explode(cells).alias("code", "value"))
    return found.unionByName(told.select("code", F.lit(None).cast("bigint").alias("_ordinal"), "value"))


@query(
    "sink_report_text",
    f"with {X.DEFECTIVE_SQL} select '  ' || rpad(severity, 8, ' ') || ' ' || code || '  ' || rpad(_ordinal::varchar, 8, ' ') || ' ' || value as line from f"
    " union all select unnest(['Validation: not conformant', 'Delivery: orders', 'Errors: ' || n || ', warnings: 0, notes: 0', '', 'Orders', '', 'File contents were examined.']) from (select count(*) as n from f)",
)
def sink_report_text(spark, sf_dir):
    path = scratch(spark, "report")
    sinks.text_report(_report(spark, sf_dir), path, "orders")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_records_tsv", f"with {X.ORDERS_SQL} select _ordinal, c0, c2, c3 from orders_text")
def sink_records_tsv(spark, sf_dir):
    path = scratch(spark, "tsv")
    sinks.records_tsv(X.orders_text(spark, sf_dir).select("_ordinal", "c0", "c2", "c3"), path)
    return spark.read.schema("_ordinal bigint, c0 string, c2 string, c3 string").option("sep", "\t").option("header", True).csv(path)
