"""Delivery descriptions (XML) as the catalog tables that the lint checks take, and as layouts.

A declared table is known by ``delivery`` and ``table_id``, its place in the description; what it is called (``table``)
need not be its alone.  What a description leaves out is null in the tables, and the standard's default in a layout.  A
setting that is no number is at its default in a layout too: the lint reports it.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from deklara.layout import DATE, DEFAULT_DATE_MASK, DEFAULT_EPOCH, NUMBER, TEXT, Column, ForeignKey, Layout
from deklara.operators.lint import KEY, TABLE, normal_path
from deklara.tables import written

# The elements that name a codepage.
CODEPAGES = ("ANSI", "Macintosh", "OEM", "UTF16", "UTF7", "UTF8")


def _record(*texts: str, **parts) -> StructType:
    return StructType([*(StructField(t, StringType()) for t in texts), *(StructField(k, v) for k, v in parts.items())])


def _list(item) -> ArrayType:
    return ArrayType(item)


_RANGE = _record("From", "To", "Length")
_COLUMN = _record("Name", "Description", "MaxLength", Numeric=_record("Accuracy", "ImpliedAccuracy"), Date=_record("Format"), Map=_list(_record("From", "To")), FixedRange=_RANGE)
_KEY = _record("References", Name=_list(StringType()), Alias=_list(_record("From", "To")))
_VARIABLE = _record("ColumnDelimiter", "RecordDelimiter", "TextEncapsulator", VariablePrimaryKey=_list(_COLUMN), VariableColumn=_list(_COLUMN), ForeignKey=_list(_KEY))
_FIXED = _record("Length", "RecordDelimiter", FixedPrimaryKey=_list(_COLUMN), FixedColumn=_list(_COLUMN), ForeignKey=_list(_KEY))
_TABLE = _record(
    "URL", "Name", "Description", *CODEPAGES, "DecimalSymbol", "DigitGroupingSymbol", "SkipNumBytes", "Epoch",
    Validity=_record("Format"), Range=_RANGE, VariableLength=_VARIABLE, FixedLength=_FIXED,
)
_MEDIUM = _record("Name", "AcceptNoTables", Command=_list(StringType()), Table=_list(_TABLE))
DESCRIPTION = _record("Version", Command=_list(StringType()), Extension=_list(_record("Name", "URL")), Media=_list(_MEDIUM))

#: Settings of a table that decide how its file is read, beside its columns.
SETTINGS = [
    "fixed", "codepage", "decimal", "grouping", "skip_bytes", "epoch", "range_from", "range_to", "range_length", "column_delimiter", "record_delimiter", "encapsulator", "record_length",
]
_OF_COLUMN = ["pos", "name", "kind", "is_pk", "mask", "span_from", "span_to", "accuracy", "implied", "max_length", "maps"]


def catalog(texts: DataFrame) -> dict[str, DataFrame]:
    """The catalog tables of descriptions (delivery, value), one XML text each, ready to be joined.

    Their joins are merges, whatever the optimizer makes of their sizes: it takes a table for a part of the descriptions'
    file, where the rows of a list are a few bytes each, and would send millions of rows by way of the driver to every task."""
    return {name: table.hint("merge") for name, table in described(texts).items()}


def described(texts: DataFrame) -> dict[str, DataFrame]:
    """What ``catalog`` returns, to be written first: joins of these tables are left to the optimizer.

    Each text is parsed once, for all tables, and dealt to all tasks before: parsing takes longer than reading it.
    Key columns come before the others by the format, so the two lists joined are the declared order."""
    data = written(texts.repartition("delivery").select("delivery", F.from_xml("value", DESCRIPTION).alias("d")), "descriptions")
    media = data.select("delivery", F.posexplode("d.Media").alias("medium_id", "m"))
    placed = media.select("delivery", "medium_id", F.col("m.Name").alias("medium"), F.posexplode("m.Table").alias("table_pos", "t"))
    v, x, t = F.col("t.VariableLength"), F.col("t.FixedLength"), F.col("t")
    keys = F.coalesce(v.VariablePrimaryKey, x.FixedPrimaryKey)
    others = F.coalesce(v.VariableColumn, x.FixedColumn)
    base = placed.select(
        "delivery", "medium_id", "medium", (F.shiftleft(F.col("medium_id").cast("bigint"), 32) + F.col("table_pos")).alias("table_id"), F.coalesce(t.Name, t.URL).alias("table"), "t",
        F.coalesce(F.size(keys), F.lit(0)).alias("_keys"), F.concat(F.coalesce(keys, F.array()), F.coalesce(others, F.array())).alias("_columns"),
        F.coalesce(v.ForeignKey, x.ForeignKey).alias("_links"),
    ).withColumn("pk_count", F.greatest("_keys", F.lit(0)))
    codepage = F.coalesce(*(F.when(t[name].isNotNull(), name) for name in CODEPAGES))
    tables = base.select(
        "delivery", "table_id", "table", "medium_id", "medium", "pk_count", t.Name.alias("name"), t.URL.alias("url"), t.Description.alias("description"), codepage.alias("codepage"),
        t.DecimalSymbol.alias("decimal"), t.DigitGroupingSymbol.alias("grouping"), t.SkipNumBytes.alias("skip_bytes"), t.Epoch.alias("epoch"), t.Validity.Format.alias("validity_mask"),
        t.Range.From.alias("range_from"), t.Range.To.alias("range_to"), t.Range.Length.alias("range_length"),
        v.ColumnDelimiter.alias("column_delimiter"), F.coalesce(v.RecordDelimiter, x.RecordDelimiter).alias("record_delimiter"), v.TextEncapsulator.alias("encapsulator"),
        x.Length.alias("record_length"), F.when(v.isNotNull(), False).when(x.isNotNull(), True).alias("fixed"),
    )
    one = base.select(*TABLE, "table", "pk_count", F.posexplode("_columns").alias("pos", "c"))
    c = F.col("c")
    kind = F.when(c.Numeric.isNotNull(), NUMBER).when(c.Date.isNotNull(), DATE).otherwise(TEXT)
    length = c.FixedRange.Length.try_cast("int")
    span_to = F.coalesce(c.FixedRange.To, F.when(length >= 1, c.FixedRange.From.try_cast("int") + length - 1).cast("string"))
    columns = one.select(
        *TABLE, "table", "pos", c.Name.alias("name"), kind.alias("kind"), (F.col("pos") < F.col("pk_count")).alias("is_pk"),
        F.when(kind == DATE, F.coalesce(c.Date.Format, F.lit(DEFAULT_DATE_MASK))).alias("mask"), c.FixedRange.From.alias("span_from"), span_to.alias("span_to"), c.Description.alias("description"),
        c.Numeric.Accuracy.alias("accuracy"), c.Numeric.ImpliedAccuracy.alias("implied"), F.when(kind == TEXT, c.MaxLength).alias("max_length"), c.Map.alias("maps"),
    )
    of_map = [*TABLE, "table", "name", "kind"]
    maps = columns.select(*of_map, F.explode("maps").alias("m")).select(*of_map, F.col("m.From").alias("map_from"), F.col("m.To").alias("map_to"))
    link = base.select(*TABLE, "table", F.posexplode("_links").alias("fk", "k"))
    link = link.select(*KEY, "table", F.col("k.References").alias("parent"), F.col("k.Name").alias("names"), F.col("k.Alias").alias("pairs"))
    named = link.select(*KEY, "table", F.posexplode("names").alias("pos", "name"))
    aliases = link.select(*KEY, "table", F.posexplode("pairs").alias("pos", "a")).select(*KEY, "table", "pos", F.col("a.From").alias("source"), F.col("a.To").alias("target"))
    commands = data.select("delivery", F.explode("d.Command").alias("name")).unionAll(media.select("delivery", F.explode("m.Command").alias("name")))
    return {
        "tables": tables,
        "columns": columns,
        "maps": maps,
        "fks": link.select(*KEY, "table", "parent"),
        "fk_columns": named.select(*KEY, "table", (F.col("pos") + 1).alias("pos"), "name"),
        "aliases": aliases,
        "media": media.select("delivery", "medium_id", F.col("m.Name").alias("medium"), F.col("m.AcceptNoTables").isNotNull().alias("accepted")),
        "commands": commands,
        "extensions": data.select("delivery", F.explode("d.Extension").alias("e")).select("delivery", F.col("e.Name").alias("name"), F.col("e.URL").alias("url")),
    }


def signatures(c: dict[str, DataFrame]) -> DataFrame:
    """Each table (delivery, table_id, table, url, path) with its ``signature``: everything that decides how its file is
    read and what its values must be, as JSON.  Deliveries of one software share their signatures."""
    columns = c["columns"].groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct(*_OF_COLUMN))).alias("columns"))
    told = F.to_json(F.struct(*SETTINGS, "columns"))
    return c["tables"].join(columns, TABLE, "left").select(*TABLE, "table", "url", normal_path(F.col("url")).alias("path"), told.alias("signature"))


class Declared(NamedTuple):
    """A table of a delivery: what it is called, where it lies, and its layout, None if no format is declared."""

    table: str
    url: str
    layout: Layout | None


def layouts(c: dict[str, DataFrame]) -> dict[int, Declared]:
    """The tables of ONE delivery's catalog by ``table_id``, in declared order.

    Only the description itself comes to the driver, which is one document, never records."""
    names, pairs, links = {}, {}, {}
    for r in c["fk_columns"].orderBy("pos").collect():
        names.setdefault((r["table_id"], r["fk"]), []).append(r["name"])
    for r in c["aliases"].orderBy("pos").collect():
        pairs.setdefault((r["table_id"], r["fk"]), []).append((r["source"], r["target"]))
    for r in c["fks"].orderBy("table_id", "fk").collect():
        key = (r["table_id"], r["fk"])
        links.setdefault(r["table_id"], []).append(ForeignKey(tuple(names.get(key, ())), r["parent"], tuple(pairs.get(key, ()))))
    return {r["table_id"]: Declared(r["table"], r["url"], layout_of(r["signature"], r["table"], tuple(links.get(r["table_id"], ())))) for r in signatures(c).orderBy("table_id").collect()}


def _whole(text: str | None, otherwise):
    return int(text) if text is not None and text.isascii() and text.isdigit() else otherwise


def layout_of(signature: str, table: str = "", links: tuple[ForeignKey, ...] = ()) -> Layout | None:
    """The layout that a signature describes; None if it declares no format."""
    t = json.loads(signature)
    if t.get("fixed") is None:
        return None
    declared = tuple(
        Column(
            c["name"], c["kind"], _whole(c.get("max_length"), None), _whole(c.get("accuracy"), None), _whole(c.get("implied"), None), c.get("mask") or DEFAULT_DATE_MASK,
            tuple((m.get("From"), m.get("To")) for m in c.get("maps") or ()), c["is_pk"], _whole(c.get("span_from"), None), _whole(c.get("span_to"), None),
        )
        for c in t.get("columns") or ()
    )
    first = _whole(t.get("range_from"), 1) or 1
    count = _whole(t.get("range_length"), None)
    last = _whole(t.get("range_to"), None if count is None else first + count - 1) if t.get("range_from") else None
    length = _whole(t.get("record_length"), max((c.end or 0 for c in declared), default=0)) if t["fixed"] else None
    return Layout(
        table, declared, t.get("column_delimiter", ";"), t.get("record_delimiter", "" if t["fixed"] else "\r\n"), "" if t["fixed"] else t.get("encapsulator", '"'),
        t.get("decimal", ","), t.get("grouping", "."), _whole(t.get("epoch"), DEFAULT_EPOCH), t.get("codepage", "ANSI"), _whole(t.get("skip_bytes"), 0), first, last, length, links,
    )
