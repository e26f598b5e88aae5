"""Readings and views on small tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from deklara.functions import checks, readings
from deklara.layout import DATE, NUMBER, Column, Layout
from deklara.operators import figures, views
from deklara.operators.views import Filter, Sort

PLAIN = Layout("T", (Column("Id", primary_key=True), Column("Betrag", NUMBER, accuracy=2), Column("Datum", DATE), Column("Text")))


def read(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["q"] for r in rows.select("i", make(F.col("v")).alias("q")).orderBy("i").collect()]


@pytest.mark.parametrize("value,good", [("1.234,56", True), ("1234,56", True), ("-5", True), ("5-", True), ("+1", True), (" 7 ", True), ("1.23", False), ("1.2345", False), (",5", False), ("5,", False), ("--5", False), ("-5-", False), ("1.234.567,8", True), ("x", False), ("1\n", True), ("12.34,5", False)])
def test_number_grammar(spark, value, good):
    assert read(spark, [value], lambda c: ~checks.not_a_number(c, PLAIN)) == [good]


def test_sign_and_implied_decimals(spark):
    three = Column("N", NUMBER, implied=3)
    assert read(spark, ["100", "6587890", "12-", ""], lambda c: readings.reading(c, three, PLAIN)) == [Decimal("0.100"), Decimal("6587.890"), Decimal("-0.012"), None]
    two = Column("N", NUMBER, implied=2)
    assert read(spark, ["12,34", "1.234,5"], lambda c: readings.reading(c, two, PLAIN, 4)) == [Decimal("0.1234"), Decimal("12.3450")]
    minus = Layout("M", (), decimal="-", grouping="")
    assert read(spark, ["1-5", "15-"], lambda c: ~checks.not_a_number(c, minus)) == [True, False]


def test_dates(spark):
    day = Column("D", DATE, mask="DD.MM.YY")
    assert [str(v) for v in read(spark, ["01.02.35", "01.02.05", "31.02.05", "1.2.05"], lambda c: readings.reading(c, day, PLAIN))] == ["1935-02-01", "2005-02-01", "None", "None"]
    full = Column("D", DATE)
    assert read(spark, ["29.02.2023", "01.01.0000", "", "01.01.2024\n"], lambda c: checks.not_a_date(c, full, PLAIN)) == [True, True, False, True]


def test_times_and_maps(spark):
    t = Column("T", maps=(("HHMMSS", "HHMMSS"),))
    assert read(spark, ["081500", "keine Zeit", "235959", "240000"], lambda c: readings.reading(c, t, PLAIN)) == [29700, None, 86399, None]
    noon = Column("T", maps=(("HH:MM TT", "HH:MM TT"),))
    assert read(spark, ["12:00 AM", "12:30 PM", "13:00 PM"], lambda c: readings.reading(c, noon, PLAIN)) == [0, 45000, None]
    m = Column("M", maps=(("A", "Apfel"), ("B", "Birne")))
    assert read(spark, ["A", "C", "", None], lambda c: readings.reading(c, m, PLAIN)) == ["Apfel", "C", "", ""]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "a", "100,00", "01.01.2024", "Äpfel"), (2, "b", "-5,00", "02.01.2024", "zebra"), (3, "c", "", "", ""), (4, "d", "1.000,00", "03.01.2024", "Apfel"), (5, "e", "100,00", "01.01.2024", "apfel"), (6, "f", "50,00", "04.01.2024", "100%_x"), (7, "g", "75,50", "05.01.2024", "Ofen"), (8, "h", "0,00", "06.01.2024", "Zebra")]
    stored = spark.createDataFrame(rows, "_ordinal bigint, c0 string, c1 string, c2 string, c3 string")
    return views.query_view(stored, PLAIN)


def ordinals(df, by="_ordinal"):
    return [r["_ordinal"] for r in df.orderBy(by).collect()]


def test_filters(table):
    def run(*f):
        return ordinals(views.filtered(table, PLAIN, list(f)))

    assert run(Filter(1, "between", ("50", "200"))) == [1, 5, 6, 7]
    assert run(Filter(1, "between", (None, None))) == [1, 2, 4, 5, 6, 7, 8]
    assert run(Filter(1, "ne", ("100",))) == [2, 4, 6, 7, 8]
    assert run(Filter(3, "ne", ("Ofen",))) == [1, 2, 4, 5, 6, 7 + 1]
    assert run(Filter(3, "matches", ("?pfel",))) == [1, 4, 5]
    assert run(Filter(3, "contains", ("%_",))) == [6]
    assert run(Filter(3, "eq", ("äPFEL",), True)) == [1]
    assert run(Filter(3, "empty")) == run(Filter(1, "empty")) == [3]


def test_refusals(table):
    with pytest.raises(ValueError):
        views.predicate(PLAIN, Filter(1, "contains", ("1",)))
    with pytest.raises(ValueError):
        views.predicate(PLAIN, Filter(1, "eq", ()))
    with pytest.raises(ValueError):
        views.order(PLAIN, [Sort(0)] * 4)
    with pytest.raises(ValueError):
        figures.figures(table, PLAIN, [(3, "sum")])


def test_sorts_and_pages(table):
    down = views.view(table, PLAIN, sorts=[Sort(1, True)])
    assert ordinals(down, "pos") == [4, 1, 5, 7, 6, 8, 2, 3]
    assert ordinals(views.view(table, PLAIN, sorts=[Sort(1)]), "pos") == [2, 8, 6, 7, 1, 5, 4, 3]
    text = ordinals(views.view(table, PLAIN, sorts=[Sort(3)]), "pos")
    assert text[-1] == 3 and text.index(5) < text.index(4) < text.index(1) < text.index(7) < text.index(2)
    assert ordinals(views.page(down, 2, 3), "pos") == [5, 7, 6]
    assert views.view(table.limit(0), PLAIN).count() == 0


def test_figures(table):
    rows = {r["figure"]: r for r in figures.figures(table, PLAIN, [(1, f) for f in ("sum", "avg", "distinct", "count")]).collect()}
    assert rows["sum"]["value"] == "1320.50" and rows["avg"]["value"] == "188.64"
    assert (rows["distinct"]["value"], rows["count"]["value"], rows["count"]["missing"]) == ("6", "7", 1)
    wide = table.withColumn("q1", F.lit("9" * 36 + ".99").cast("decimal(38,2)"))
    r = figures.figures(wide, PLAIN, [(1, "sum")]).first()
    assert r["value"] is None and not r["exact"]
