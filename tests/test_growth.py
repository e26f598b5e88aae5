"""What the work of a query grows with: plans and places, on small tables."""

import os
import random
from dataclasses import replace

from pyspark.sql import functions as F

from deklara.layout import Column
from deklara.operators import keys as J
from deklara.plans import QUERIES, files
from deklara.sources import catalog as C
from deklara.sources import scan as S


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_a_description_is_parsed_once_for_all_tables(spark):
    """each table of the catalog parsed every description again."""
    xml = "<DataSet><Media><Name>M</Name><Table><URL>a</URL><VariableLength><VariablePrimaryKey><Name>K</Name><AlphaNumeric/></VariablePrimaryKey></VariableLength></Table></Media></DataSet>"
    found = C.catalog(spark.range(5).select(F.col("id").cast("string").alias("delivery"), F.lit(xml).alias("value")))
    assert not [name for name, table in found.items() if "from_xml" in _plan(table).lower() or "xmltostructs" in _plan(table).lower()]
    assert found["columns"].count() == found["tables"].count() == 5


def test_catalog_tables_are_not_sent_through_the_driver(spark):
    """F1 of round 4: joins of the catalog's tables were broadcasts of all their rows, since their files are small."""
    xml = "<DataSet><Media><Name>M</Name><Table><URL>a</URL><VariableLength><VariableColumn><Name>K</Name><AlphaNumeric/><Map><From>B</From><To>K</To></Map></VariableColumn></VariableLength></Table></Media></DataSet>"
    found = C.catalog(spark.range(5).select(F.col("id").cast("string").alias("delivery"), F.lit(xml).alias("value")))
    both = found["columns"].join(found["tables"].select("delivery", "table_id", "url"), ["delivery", "table_id"]).join(found["maps"].select("delivery", "map_to"), "delivery", "left")
    assert sorted((r["delivery"], r["name"], r["url"], r["map_to"]) for r in both.collect()) == [(str(i), "K", "a", "K") for i in range(5)]
    rows = QUERIES["load_catalog"](spark, "/root/testdata/sf0.001")
    for df in (both, rows):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)
    assert rows.count() == 5 * spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()


def test_a_split_is_taken_in_pieces(spark, tmp_path):
    """one task held all lines of a split, and one sorted all lines of a file that it wrote."""
    rows = spark.range(40_000).select(F.col("id").alias("_ordinal"), F.concat(F.col("id").cast("string"), F.lit(";x;y")).alias("value"))
    path = f"{tmp_path}/t"
    files._write_one(rows.repartition(3), path, "\r\n")
    parts = [p for p in os.listdir(path) if p.startswith("part-")]
    with open(f"{path}/{parts[0]}", newline="") as text:
        assert len(parts) == 1 and text.read() == "".join(f"{i};x;y\r\n" for i in range(40_000))
    held = S.lines(spark, path, files.PLAIN).groupBy("path", "block").count().agg(F.max("count"), F.sum("count")).first()
    assert held[0] <= 1 << S.PIECE and held[1] == 40_000


def test_records_over_the_borders_of_pieces(spark, tmp_path, monkeypatch):
    """Values that hold delimiters begin and end in any piece; the files of a table follow each other."""
    monkeypatch.setattr(S, "PIECE", 2)
    rng, expected = random.Random(5), []
    os.mkdir(tmp_path / "t")
    for name in ("a b.txt", "c.txt"):
        rows = [(str(i), "".join(rng.choice('xä;"\r\n ') for _ in range(rng.randint(0, 12))), "\r\n" * rng.randint(0, 9)) for i in range(150)]
        quoted = lambda v: '"' + v.replace('"', '""') + '"'
        (tmp_path / "t" / name).write_bytes("".join(";".join((a, quoted(b), quoted(c))) + "\r\n" for a, b, c in rows).encode())
        expected += rows
    found = S.scan_delimited(spark, f"{tmp_path}/t", files.PLAIN).orderBy("_ordinal").collect()
    assert [tuple(r[f"c{i}"] for i in range(3)) for r in found] == expected and [r["_ordinal"] for r in found] == list(range(1, 301))


def test_lines_of_undelimited_records_are_put_together(spark, tmp_path, monkeypatch):
    """every line feed within the records made a row that was shuffled and sorted."""
    text = "".join(random.Random(6).choice("ab\n\nß") for _ in range(25 * 400)) + "xyz"
    os.mkdir(tmp_path / "t")
    for name, body in (("1", text), ("2", "﻿" + text)):
        (tmp_path / "t" / name).write_bytes(body.encode())
    assert S._chunks(spark, f"{tmp_path}/t").count() == 2
    expected = [text[i : i + 25] for i in range(0, len(text), 25)] * 2
    for piece in (1, 14):
        monkeypatch.setattr(S, "PIECE", piece)
        layout = replace(files._BARE, columns=(Column("All", start=1, end=25),))
        found = S.scan_fixed(spark, f"{tmp_path}/t", layout).orderBy("_ordinal").collect()
        assert [r["c0"] for r in found] == expected
        found = S.scan_fixed(spark, f"{tmp_path}/t/1", replace(layout, codepage="ANSI", skip_bytes=7)).orderBy("_ordinal").collect()
        data = text.encode()[7:]
        assert [r["n_chars"] for r in found] == [len(data[i : i + 25]) for i in range(0, len(data), 25)]


def test_key_values_take_no_uncompiled_function(spark):
    """functions with lambdas were called for every record and key."""
    links = spark.createDataFrame([("d", 0, -1, 0, "T", [2, 0]), ("d", 0, 0, 1, "U", [1])], "delivery string, table_id bigint, fk int, target_id bigint, target string, positions array<int>")
    records = spark.createDataFrame([("d", 0, "T", 1, "a", "", "c"), ("d", 0, "T", 2, "a", "b", "")], "delivery string, table_id bigint, `table` string, _ordinal bigint, c0 string, c1 string, c2 string")
    found = J.key_values(records, links, 3)
    assert "lambda" not in _plan(found)
    assert sorted((r["_ordinal"], r["fk"], r["key"]) for r in found.collect()) == [(1, -1, ["c", "a"]), (2, -1, ["", "a"]), (2, 0, ["b"])]
    assert J.key_values(records, links.limit(0), 3).count() == 0


def test_key_values_are_written_once(spark, tmp_path, monkeypatch):
    """all key values were copied once more before they were checked."""
    from deklara import delivery

    xml = """<DataSet><Version>1.0</Version><Media><Name>M</Name><Table><URL>a.csv</URL><Name>A</Name><UTF8/><VariableLength>
<VariablePrimaryKey><Name>K</Name><AlphaNumeric/></VariablePrimaryKey></VariableLength></Table></Media></DataSet>"""
    (tmp_path / "index.xml").write_text(xml)
    (tmp_path / "a.csv").write_text("1\r\n2\r\n1\r\n")
    names, write = [], delivery.written
    monkeypatch.setattr(delivery, "written", lambda df, name: (names.append(name), write(df, name))[1])
    found = [(str(r["code"]), r["value"]) for r in delivery.validate(spark, str(tmp_path)).collect()]
    assert [f for f in found if f[0].startswith("5")] == [("5001", "1")], found
    assert "table" in names and "keys" not in names


def test_records_without_defects_are_left_out_before_findings_are_made(spark):
    from deklara.operators import conformance
    from deklara.plans import fixtures

    rows = fixtures.orders_defective(spark, "/root/testdata/sf0.001")
    found = conformance.value_findings(rows, fixtures.ORDERS)
    plan = found._jdf.queryExecution().analyzed().toString().lower()
    assert "filter" in plan.split("generate explode")[1]
    assert 0 < found.select("_ordinal").distinct().count() < rows.count()
