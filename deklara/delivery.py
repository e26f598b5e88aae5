"""Deliveries from their descriptions to their report: declarations, files, records, headers and keys.

Any number of deliveries is validated by the same plans.  Tables are grouped by signature, that is by all that decides how
a file is read and what its values must be; the files of a group are scanned together, whoever's they are, and
their findings and key values are appended to two scratch tables.  Keys are then checked for all tables at once.  So the plans
grow with the number of different layouts, one at a time, and not with the number of deliveries or tables.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deklara.layout import Layout
from deklara.operators import conformance as N
from deklara.operators import keys as J
from deklara.operators import lint as L
from deklara.sources import scan as S
from deklara.sources.catalog import described, layout_of, signatures
from deklara.tables import all_written, scratch, written

INDEX = "index.xml"


def _entries(spark: SparkSession, root: str, many: bool) -> DataFrame:
    """(delivery, name, file) of the entries of one delivery, or of the deliveries in the folders of ``root``."""
    files = S.entries(spark, root).select("name", "file")
    if not many:
        return files.select(F.lit(root).alias("delivery"), "name", "file")
    inner = F.split_part("name", F.lit("/"), F.lit(1))
    return files.where(F.contains("name", F.lit("/"))).select(inner.alias("delivery"), F.substring("name", F.length(inner) + 2, F.length("name")).alias("name"), "file")


def _parent(name) -> F.Column:
    return F.regexp_extract(name, r"^(.+)/[^/]*$", 1)


def _named(entries: DataFrame) -> DataFrame:
    """The names that locations can mean.  A folder of part files counts as a file of its name too."""
    folders = entries.select("delivery", _parent("name").alias("name")).where("name <> ''").distinct()
    return entries.select("delivery", "name").unionAll(folders.join(entries, ["delivery", "name"], "left_anti"))


def lint(c: dict[str, DataFrame]) -> DataFrame:
    """All checks of a catalog's declarations (delivery, table, code, severity, subject)."""
    fks, named, columns, tables, aliases = c["fks"], c["fk_columns"], c["columns"], c["tables"], c["aliases"]
    parts = [
        L.fk_column(named, columns), L.references(fks, tables), L.parent_key(fks, tables), L.arity(fks, named, tables), L.datatype(fks, named, aliases, columns, tables),
        L.alias(aliases, fks, named, columns, tables), L.maps(c["maps"]), L.empty_media(c["media"], tables), L.spans(columns, tables), L.scalars(tables, columns), L.symbols(tables),
        L.date_masks(columns, tables), L.identity(tables, columns, fks), L.naming(columns, tables), L.commands(c["commands"]), L.extensions(c["extensions"], c["entries"]),
        L.file_presence(tables, c["entries"]),
    ]
    return N.union(parts)


def _as_findings(found: DataFrame) -> DataFrame:
    cells = [F.col("code"), F.col("severity"), F.lit(-1), F.lit(0), F.col("table"), F.lit(None).cast("bigint"), F.lit(-1), F.lit(""), F.col("subject"), F.lit("")]
    return found.select("delivery", *(c.alias(n) for c, n in zip(cells, N.COLUMNS, strict=True)))


def validate(spark: SparkSession, root: str, many: bool = False) -> DataFrame:
    """All findings (``delivery`` and ``conformance.COLUMNS``) of the delivery in a folder whose ``index.xml`` describes it;
    with ``many``, of the deliveries in the folders of ``root``.

    The driver reads the different layouts and the names of files, never records.  ``conformance.bounded`` bounds the
    findings of each table, ``conformance.verdicts`` gives each delivery's outcome, and ``sinks`` report them."""
    entries = written(_entries(spark, root, many), "entries")
    indexes = entries.where(F.col("name").isin(INDEX) | (_parent("name") == INDEX))
    if not many and entries.isEmpty():
        none = spark.range(1).select(F.lit(root).alias("delivery"), F.lit("").alias("table"), F.lit("1001").alias("code"), F.lit("error").alias("severity"), F.lit(INDEX).alias("subject"))
        return _as_findings(none)
    found = [_as_findings(L.index_presence(_named(entries), INDEX)), _as_findings(L.entry_collision(entries))]
    if indexes.isEmpty():
        return N.union(found)
    texts = spark.read.text(f"{root}/*/{INDEX}" if many else f"{root}/{INDEX}", wholetext=True)
    texts = texts.select(S.plain_path(F.col("_metadata.file_path")).alias("file"), "value").join(indexes.select("delivery", "file"), "file")
    c = all_written(described(texts.select("delivery", "value")) | {"entries": _named(entries)}, "catalog")
    found.append(_as_findings(lint(c)))
    declared = written(signatures(c), "signatures")
    pieces = entries.select("delivery", F.explode(F.array(L.entry_name(F.col("name")), _parent(L.entry_name(F.col("name"))))).alias("path"), "file").where("path <> ''")
    files = written(declared.join(pieces, ["delivery", "path"]).select(*S.OWNER, "signature", "file"), "files")
    findings, key_values = scratch(spark, "findings"), scratch(spark, "key-values")
    ready = files.join(declared.where(_usable(declared)).select(*L.TABLE), L.TABLE, "left_semi").select(*L.TABLE).distinct()
    ready = written(ready, "ready")
    # Keys of tables that are not read are not compared: a finding says so.
    links = written(J.links(c).join(ready.withColumnRenamed("table_id", "target_id"), ["delivery", "target_id"], "left_semi"), "links")
    _schemas(spark, findings, key_values, links)
    for r in declared.select("signature").distinct().orderBy("signature").collect():
        own = lambda rows: rows.where(F.col("signature") == r["signature"]).drop("signature")  # noqa: B023, E731
        layout = layout_of(r["signature"])
        reason = "no format" if layout is None else S.unusable(layout)
        if reason:
            N.unreadable_findings(own(declared).withColumn("reason", F.lit(reason))).write.mode("append").parquet(findings)
        else:
            _group(spark, layout, own(files), links, findings, key_values)
    found.append(spark.read.parquet(findings))
    found += N.key_value_findings(spark.read.parquet(key_values))
    known = c["tables"].join(ready.withColumn("ready", F.lit(True)), L.TABLE, "left").select(*S.OWNER, "pk_count", F.coalesce("ready", F.lit(False)).alias("ready"))
    found.append(N.unchecked_findings(c["fks"], known))
    return N.union(found)


def _usable(declared: DataFrame) -> F.Column:
    """Whether a table's signature gives a reading."""
    bad = [r["signature"] for r in declared.select("signature").distinct().collect() if (layout := layout_of(r["signature"])) is None or S.unusable(layout)]
    return ~F.col("signature").isin(bad)


def _schemas(spark: SparkSession, findings: str, key_values: str, links: DataFrame) -> None:
    """The two scratch tables, empty, so that they can be read whatever is appended."""
    none = spark.range(0).select(F.lit("").alias("delivery"), F.lit("").alias("table"), F.lit("").alias("url"), F.lit("").alias("reason"))
    N.unreadable_findings(none).write.parquet(findings)
    J.key_values(spark.createDataFrame([], "delivery string, table_id bigint, `table` string, _ordinal bigint"), links, 0).write.parquet(key_values)


def _group(spark: SparkSession, layout: Layout, files: DataFrame, links: DataFrame, findings: str, key_values: str) -> None:
    """Scan the files of one layout, and append what their records break and their key values."""
    paths = sorted({r["file"] for r in files.select("file").collect()})  # names of declared files alone
    if not paths:
        return
    everything = replace(layout, first_record=1, last_record=None)
    read = S.scan_delimited if layout.record_length is None else S.scan_fixed
    records = written(read(spark, paths, everything, files), "table")
    if layout.record_length is None:
        N.header_findings(records, layout).write.mode("append").parquet(findings)
    data = S.in_range(records, layout)
    N.conformance(data, layout).write.mode("append").parquet(findings)
    J.key_values(data, links, len(layout.columns)).write.mode("append").parquet(key_values)
