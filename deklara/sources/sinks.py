"""Reports and records as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deklara.operators.conformance import counts, report_order
from deklara.tables import written


SCHEMA_VERSION = 1


def json_report(findings: DataFrame, path: str, export: str = "", strict: bool = False, examined: bool = True) -> None:
    """Two folders: ``report`` with one object (schema version, export, verdict, counts), and ``findings`` with one
    object for each finding, in any number of files."""
    findings.select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{path}/findings")
    told = counts(findings, strict).select(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(export).alias("export"), "verdict", F.lit(strict).alias("strict"), F.lit(examined).alias("contentsExamined"),
        F.struct(F.col("errors").alias("error"), F.col("warnings").alias("warning"), F.col("notes").alias("info")).alias("counts"),
    )
    told.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/report")


def report_line() -> Column:
    """A finding as one printable line under its group."""
    return F.format_string("  %-8s %s  %-8s %s", "severity", "code", F.coalesce(F.col("_ordinal").cast("string"), F.lit("-")), F.regexp_replace("value", r"[\x00-\x1f]", " "))


def report_lines(findings: DataFrame, export: str = "", strict: bool = False, examined: bool = True) -> DataFrame:
    """The report's lines (place, part, value): verdict and counts, then each group under one heading in the
    report's order, then whether contents were read."""
    placed = written(report_order(findings), "report")
    text = lambda c: c.cast("string")
    head = counts(findings, strict).select(
        F.posexplode(F.array(
            F.concat(F.lit("Validation: "), F.col("verdict")),
            F.lit(f"Delivery: {export}"),
            F.concat(F.lit("Errors: "), text(F.col("errors")), F.lit(", warnings: "), text(F.col("warnings")), F.lit(", notes: "), text(F.col("notes"))),
        )).alias("part", "value")
    ).select(F.lit(0).cast("bigint").alias("place"), "part", "value")
    group = F.when(F.col("table") == "", "General").otherwise(F.col("table"))
    groups = placed.groupBy("table").agg(F.min("place").alias("place")).select("place", F.posexplode(F.array(F.lit(""), group)).alias("part", "value"))
    scope = "File contents were examined." if examined else "File contents were not examined."
    last = findings.agg(F.count("*").alias("n")).select((F.col("n") + 1).alias("place"), F.posexplode(F.array(F.lit(""), F.lit(scope))).alias("part", "value"))
    return head.unionAll(groups).unionAll(placed.select("place", F.lit(2), report_line())).unionAll(last)


def text_report(findings: DataFrame, path: str, export: str = "", strict: bool = False, examined: bool = True) -> None:
    """The report as text, sorted over its files."""
    report_lines(findings, export, strict, examined).sort("place", "part").select("value").write.text(path)


def records_tsv(records: DataFrame, path: str) -> None:
    """Records with a header, tab-separated, cells quoted only where they must be."""
    records.write.option("sep", "\t").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
