"""Findings, fixed records, codepages, bounds, reports and whole deliveries on small fixtures."""

import pytest
from pyspark.sql import functions as F

from deklara.delivery import validate
from deklara.functions import readings as R
from deklara.layout import DATE, NUMBER, Column, ForeignKey, Layout
from deklara.operators import conformance as N
from deklara.operators import lint as L
from deklara.sources import scan, sinks
from deklara.sources.catalog import catalog, layouts

FIXED = Layout("F", (Column("A", start=1, end=3), Column("B", start=4, end=5)), record_length=5, record_delimiter="")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("codepage, charset", [("ANSI", "cp1252"), ("OEM", "cp850"), ("Macintosh", "mac_roman"), ("UTF16", "utf-16-le"), ("UTF8", "utf-8")])
@pytest.mark.parametrize("tail", ["", "zz"])
def test_fixed_without_delimiter(spark, tmp_path, codepage, charset, tail):
    """Line feeds are characters like others; a short last record is one, and a finding."""
    path = tmp_path / "f.txt"
    text = "äb\n12cde\n\nfÖh34" + tail
    path.write_bytes(text.encode(charset))
    layout = Layout("F", FIXED.columns, codepage=codepage, record_length=5, record_delimiter="")
    read = scan.scan_fixed(spark, str(path), layout)
    wanted = [(i // 5 + 1, text[i : i + 3], text[i + 3 : i + 5]) for i in range(0, len(text), 5)]
    assert sorted(rows(read, "_ordinal", "c0", "c1")) == wanted
    assert rows(N.record_findings(read, layout), "code", "value", "expected") == ([("4007", "2", "5")] if tail else [])


def test_fixed_skips_bytes(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_bytes(b"##\n" + b"abc12def34")
    layout = Layout("F", FIXED.columns, record_length=5, record_delimiter="", skip_bytes=3)
    assert sorted(rows(scan.scan_fixed(spark, str(path), layout), "_ordinal", "c0", "c1")) == [(1, "abc", "12"), (2, "def", "34")]


def test_fixed_of_empty_file(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_bytes(b"")
    assert scan.scan_fixed(spark, str(path), FIXED).count() == 0


def test_every_byte_of_a_codepage(spark):
    for codepage, charset in (("ANSI", "cp1252"), ("OEM", "cp850"), ("Macintosh", "mac_roman")):
        data = bytes(range(1, 256))
        found = spark.createDataFrame([(data,)], "b binary").select(scan.decoded(F.col("b"), Layout("T", (), codepage=codepage))).first()[0]
        assert found == data.decode(charset, errors="replace")


def test_record_findings(spark):
    layout = Layout("T", tuple(Column(n) for n in "abc"), codepage="UTF8")
    data = [(1, "x", "y", "z", 3, False), (2, "x", "", "", 1, False), (3, "x", "�", "z", 3, True), (4, "x", "y", "z", 5, True)]
    found = N.record_findings(spark.createDataFrame(data, "_ordinal bigint, c0 string, c1 string, c2 string, n_values int, unterminated boolean"), layout)
    assert sorted(rows(found, "_ordinal", "code", "column_index", "column", "value", "expected")) == [
        (2, "4004", -1, "", "1", "3"), (3, "4005", 1, "b", "", "UTF8"), (3, "4006", 2, "c", "", '"'), (4, "4004", -1, "", "5", "3"), (4, "4006", 4, "", "", '"'),
    ]


@pytest.mark.parametrize(
    "first, first_record, code",
    [("a b c", 1, "4010"), ("c a b", 1, "4010"), ("a b c", 2, None), ("c a b", 2, "4009"), ("a b d", 2, None), ("a a b", 2, None), (" a b c", 1, None)],
)
def test_header(spark, first, first_record, code):
    layout = Layout("T", tuple(Column(n) for n in "abc"), first_record=first_record)
    cells = first.split(" ")
    data = [(1, *cells[:3], len(cells)), (2, "a", "b", "c", 3)]
    found = N.header_findings(spark.createDataFrame(data, "_ordinal bigint, c0 string, c1 string, c2 string, n_values int"), layout)
    assert [r[0] for r in rows(found, "code")] == ([code] if code else [])


def test_keys(spark):
    layout = Layout("T", (Column("a", primary_key=True), Column("b")))
    t = spark.createDataFrame([(1, "k", "p"), (2, "", "q"), (3, "k", ""), (4, "m", "p")], "_ordinal bigint, c0 string, c1 string")
    assert rows(N.incomplete_key_findings(t, ["c0"], layout), "code", "_ordinal") == [("5002", 2)]
    assert rows(N.duplicate_key_findings(t, ["c0"], layout), "code", "_ordinal", "value", "expected") == [("5001", 1, "k", "1, 3")]
    parent = spark.createDataFrame([("p",)], "c0 string")
    assert rows(N.reference_findings(t, ["c1"], parent, ["c0"], layout, "P"), "code", "_ordinal", "value", "expected") == [("5003", 2, "q", "P")]


def test_exit_class_and_report(spark, tmp_path):
    cell = lambda code, severity, table, at: (code, severity, 1, 0, table, at, -1, "", "v", "")
    schema = "code string, severity string, pass int, seq int, `table` string, _ordinal bigint, column_index int, `column` string, value string, expected string"
    frame = lambda cells: spark.createDataFrame(cells, schema)
    warning, error, tool = cell("5004", "warning", "B", None), cell("4001", "error", "A", 2), cell("9004", "error", "", None)
    classes = [N.exit_class(frame(c), strict).first()[0] for c, strict in (([], False), ([warning], False), ([warning], True), ([warning, error], False), ([tool, error], False))]
    assert classes == [0, 1, 2, 2, 3]
    found = frame([error, cell("4001", "error", "A", 1), warning])
    sinks.text_report(found, str(tmp_path / "r"), "x")
    text = [line for p in sorted((tmp_path / "r").glob("part-*")) for line in p.read_text().splitlines()]
    assert text == [
        "Validation: not conformant", "Delivery: x", "Errors: 2, warnings: 1, notes: 0", "", "A", "  error    4001  1        v", "  error    4001  2        v",
        "", "B", "  warning  5004  -        v", "", "File contents were examined.",
    ]


def test_bounds_and_times(spark):
    layout = Layout("T", (Column("n", NUMBER), Column("d", DATE), Column("t", maps=(("HH:MM TT", "HH:MM TT"),)), Column("x")))
    typed = [("1.234,5-", "31.12.1999", "12:05 AM", "a"), ("1,2,3", "31.02.1999", "13:05 AM", ""), ("", "", "", "b")]
    df = spark.createDataFrame(typed, "n string, d string, t string, x string")
    got = df.select(*(R.read_bound(F.col(c.name), c, layout).alias(c.name) for c in layout.columns)).collect()
    assert [[(v.bound, v.refused) for v in r] for r in got] == [
        [("-1234.5", False), ("1999-12-31", False), ("00:05:00", False), ("a", False)], [("", True), ("", True), ("", True), ("", False)], [("", False), ("", False), ("", False), ("b", False)],
    ]
    seconds = spark.createDataFrame([(0,), (43199,), (43200,), (46801,)], "s int")
    assert [r[0] for r in seconds.select(R.write_time(F.col("s"), layout.columns[2])).collect()] == ["12:00 AM", "11:59 AM", "12:00 PM", "01:00 PM"]
    assert seconds.select(R.write_time(F.col("s"), layout.columns[3])).collect()[3][0] == "130001"


INDEX = """<?xml version="1.0" encoding="utf-8"?>
<DataSet><Version>1.0</Version><Command>run me</Command><Media><Name>M1</Name>
<Table><URL>data/k.csv</URL><Name>Kunden</Name><Range><From>2</From></Range><VariableLength>
<VariablePrimaryKey><Name>Nr</Name><AlphaNumeric/></VariablePrimaryKey><VariableColumn><Name>Name</Name><AlphaNumeric/><MaxLength>x</MaxLength></VariableColumn></VariableLength></Table>
<Table><URL>b.txt</URL><Name>Belege</Name><DecimalSymbol>.</DecimalSymbol><FixedLength><Length>6</Length>
<FixedPrimaryKey><Name>Beleg</Name><AlphaNumeric/><FixedRange><From>1</From><Length>2</Length></FixedRange></FixedPrimaryKey>
<FixedColumn><Name>Kunde</Name><Numeric><Accuracy>0</Accuracy></Numeric><FixedRange><From>3</From><To>6</To></FixedRange></FixedColumn>
<ForeignKey><Name>Kunde</Name><References>Kunden</References><Alias><From>Kunde</From><To>Nr</To></Alias></ForeignKey>
<ForeignKey><Name>Kunde</Name><References>Alt</References></ForeignKey></FixedLength></Table>
<Table><URL>alt.csv</URL><Name>Alt</Name><UTF7/><VariableLength><VariablePrimaryKey><Name>A</Name><Numeric/></VariablePrimaryKey></VariableLength></Table>
</Media></DataSet>"""


def test_layouts(spark):
    found = layouts(catalog(spark.createDataFrame([("d", INDEX)], "delivery string, value string")))
    found = {d.table: d for d in found.values()}
    assert found["Kunden"].url == "data/k.csv" and found["Kunden"].layout == Layout("Kunden", (Column("Nr", primary_key=True), Column("Name")), first_record=2)
    links = (ForeignKey(("Kunde",), "Kunden", (("Kunde", "Nr"),)), ForeignKey(("Kunde",), "Alt"))
    columns = (Column("Beleg", primary_key=True, start=1, end=2), Column("Kunde", NUMBER, accuracy=0, start=3, end=6))
    assert found["Belege"].layout == Layout("Belege", columns, record_delimiter="", encapsulator="", decimal=".", record_length=6, foreign_keys=links)


def test_delivery(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "index.xml").write_text(INDEX)
    (tmp_path / "data" / "k.csv").write_bytes("Name;Nr\r\n0001;Größe\r\n0001;b;c\r\n".encode("cp1252"))
    (tmp_path / "b.txt").write_bytes(b"010001020002xxab")
    (tmp_path / "alt.csv").write_bytes(b"1\r\n")
    found = sorted((r["code"], r["table"], r["_ordinal"] or 0, r["value"]) for r in validate(spark, str(tmp_path)).collect())
    assert found == [
        ("3006", "Belege", 0, "Kunde"), ("3019", "Kunden", 0, "Name/MaxLength"), ("3029", "", 0, "run me"),
        ("4001", "Belege", 3, "ab"), ("4004", "Kunden", 3, "3"), ("4007", "Belege", 3, "4"), ("4009", "Kunden", 1, "Name, Nr"), ("4011", "Alt", 0, "alt.csv"),
        ("5001", "Kunden", 2, "0001"), ("5003", "Belege", 2, "0002"), ("5003", "Belege", 3, "ab"), ("5004", "Belege", 0, "Alt"),
    ]


def test_delivery_without_description(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    assert rows(validate(spark, str(tmp_path)), "code") == [("1001",)]
    (tmp_path / "deep" / "index.xml").write_text(INDEX)
    assert rows(validate(spark, str(tmp_path)), "code") == [("1002",)]


def test_types_of_aliased_keys(spark):
    frame = lambda cells, schema: spark.createDataFrame(cells, schema)
    columns = frame([("d", 1, "A", 0, "x", "text", False), ("d", 2, "P", 0, "k", "text", True), ("d", 2, "P", 1, "n", "number", True)], "delivery string, table_id int, `table` string, pos int, name string, kind string, is_pk boolean")
    fks, names = frame([("d", 1, "A", 0, "P")], "delivery string, table_id int, `table` string, fk int, parent string"), frame([("d", 1, "A", 0, 1, "x")], "delivery string, table_id int, `table` string, fk int, pos int, name string")
    tables = frame([("d", 1, "A", 0), ("d", 2, "P", 2)], "delivery string, table_id int, `table` string, pk_count int")
    pairs = "delivery string, table_id int, `table` string, fk int, pos int, source string, target string"
    assert rows(L.datatype(fks, names, frame([], pairs), columns, tables), "subject") == []
    assert rows(L.datatype(fks, names, frame([("d", 1, "A", 0, 0, "x", "n"), ("d", 1, "A", 0, 1, "x", "k")], pairs), columns, tables), "subject") == [("x",)]
    twice = tables.unionAll(frame([("d", 3, "P", 2)], tables.schema))
    assert rows(L.datatype(fks, names, frame([("d", 1, "A", 0, 0, "x", "n")], pairs), columns, twice), "subject") == []


def table(name, url, columns, more=""):
    named = f"<Name>{name}</Name>" if name else ""
    return f"<Table><URL>{url}</URL>{named}<VariableLength>{columns}{more}</VariableLength></Table>"


KEY, NUMBER_COLUMN = "<VariablePrimaryKey><Name>K</Name><AlphaNumeric/></VariablePrimaryKey>", "<VariableColumn><Name>N</Name><Numeric/></VariableColumn>"
REFERENCE = "<VariableColumn><Name>R</Name><AlphaNumeric/></VariableColumn>", "<ForeignKey><Name>R</Name><References>T</References></ForeignKey>"


def delivery(folder, tables, files, extra=""):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "index.xml").write_text(f"<DataSet>{extra}<Version>1</Version><Media><Name>M</Name>{''.join(tables)}</Media></DataSet>")
    for name, text in files.items():
        (folder / name).write_bytes(text.replace("\n", "\r\n").encode("cp1252"))


def told(found):
    return sorted((r["code"], r["table"], r["_ordinal"] or 0, r["value"]) for r in found.collect())


def test_two_tables_of_one_name(spark, tmp_path):
    """Both files are read, each under its own declaration; a reference to the name is ambiguous and not followed."""
    twins = [table("T", "a.csv", KEY + NUMBER_COLUMN), table("T", "b.csv", KEY + NUMBER_COLUMN)]
    files = {"a.csv": "x;1\ny;xx\n", "b.csv": "x;1\nx;2\n"}
    delivery(tmp_path / "one", twins, files)
    found = validate(spark, str(tmp_path / "one")).collect()
    assert sorted((r["code"], r["severity"], r["table"], r["_ordinal"], r["value"]) for r in found) == [
        ("3024", "warning", "", None, "T"), ("4001", "error", "T", 2, "xx"), ("5001", "error", "T", 1, "x"),
    ]
    delivery(tmp_path / "two", [*twins, table("C", "c.csv", KEY + REFERENCE[0], REFERENCE[1])], files | {"c.csv": "1;nowhere\n"})
    found = validate(spark, str(tmp_path / "two")).collect()
    assert sorted((r["code"], r["severity"], r["table"]) for r in found) == [("3003", "error", "C"), ("3024", "error", ""), ("4001", "error", "T"), ("5001", "error", "T")]


def test_tables_without_a_name_go_by_their_location(spark, tmp_path):
    """Their references resolve; one location declared twice is reported once, and is no repeated name."""
    unnamed = [table("", "T", KEY), table("", "T", KEY + NUMBER_COLUMN), table("C", "c [1],{+}.csv", KEY + REFERENCE[0], REFERENCE[1].replace(">T<", ">p.csv<")), table("", "p.csv", KEY)]
    delivery(tmp_path, unnamed, {"T": "x\n", "c [1],{+}.csv": "1;a\n2;b\n", "p.csv": "a\n"})
    assert told(validate(spark, str(tmp_path))) == [("3025", "", 0, "T"), ("4004", "T", 1, "1"), ("5003", "C", 2, "b")]


def test_extensions_and_collisions(spark, tmp_path):
    delivery(tmp_path, [table("T", "t.csv", KEY)], {"t.csv": "x\n", "plan.bin": ""}, "<Extension><Name>E</Name><URL>x/../plan.bin</URL></Extension><Extension><Name>F</Name><URL>gone.bin</URL></Extension>")
    assert told(validate(spark, str(tmp_path))) == [("3030", "", 0, "E"), ("3030", "", 0, "F"), ("3031", "", 0, "F")]
    entries = spark.createDataFrame([("d", "a\\b"), ("d", "/a/b"), ("d", "a/./b")], "delivery string, name string")
    assert rows(L.entry_collision(entries), "code", "subject") == [("1007", "a/b")]


def test_many_deliveries_have_the_plan_of_few(spark, tmp_path):
    """What is found is what each delivery alone gives, and the plan does not grow with their number."""
    wide = [table("T", "t.csv", KEY + NUMBER_COLUMN), table("C", "c.csv", KEY + REFERENCE[0], REFERENCE[1])]
    for root, n in (("few", 2), ("many", 12)):
        for i in range(n):
            delivery(tmp_path / root / f"d{i}", wide, {"t.csv": f"x;1\ny;x{i}\n" + "z;2\nz;3\n" * (i % 2), "c.csv": f"1;x\n2;u{i}\n3;\n"} if i % 7 else {"t.csv": "x;1\n"})
    (tmp_path / "many" / "empty").mkdir()
    (tmp_path / "many" / "empty" / "note.txt").write_text("x")
    found = {root: validate(spark, str(tmp_path / root), many=True) for root in ("few", "many")}
    sizes = [len(f._jdf.queryExecution().optimizedPlan().toString()) for f in found.values()]
    assert sizes[1] < 1.1 * sizes[0]
    by_delivery = {}
    for r in found["many"].collect():
        by_delivery.setdefault(r["delivery"], []).append((r["code"], r["table"], r["_ordinal"] or 0, r["value"]))
    assert sorted(by_delivery.pop("empty")) == [("1001", "", 0, "index.xml")]
    for i in (11,):
        assert sorted(by_delivery[f"d{i}"]) == told(validate(spark, str(tmp_path / "many" / f"d{i}")))
    assert len(by_delivery) == 12 and ("5003", "C", 2, "u11") in by_delivery["d11"] and ("1003", "C", 0, "c.csv") in by_delivery["d7"]
    outcome = N.verdicts(found["few"], spark.createDataFrame([("d0",), ("d1",), ("d9",)], "delivery string")).collect()
    assert {r["delivery"]: (r["errors"], r["verdict"]) for r in outcome} == {"d0": (1, "not conformant"), "d1": (3, "not conformant"), "d9": (0, "conformant")}


def test_lists_of_many_records(spark):
    """A key of more records than a list holds has several lists; the others one each, in file order."""
    from deklara.operators import keys

    t = spark.createDataFrame([(i, "k" if i % 3 else f"s{i % 2}") for i in range(1, 41)], "_ordinal bigint, c0 string")
    found = sorted((r["key"], r["n"], r["first"], r["records"]) for r in keys.duplicates(t, ["c0"], most=10).collect())
    hot = [str(i) for i in range(1, 41) if i % 3]
    assert [f for f in found if f[0] == "k"] == sorted(("k", 27, 1, ", ".join(hot[i : i + 10])) for i in (0, 10, 20))
    assert [f for f in found if f[0] != "k"] == [(f"s{b}", len(own), own[0], ", ".join(map(str, own))) for b in (0, 1) for own in [[i for i in range(3, 41, 3) if i % 2 == b]]]


def test_entries(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "ä+b.csv").write_bytes(b"12345")
    (tmp_path / "sub dir" / "c.csv").write_bytes(b"")
    found = scan.entries(spark, str(tmp_path))
    assert sorted(rows(found, "name", "length")) == [("sub dir/c.csv", 0), ("ä+b.csv", 5)]
    assert sorted(rows(found, "file")) == [(f"file://{tmp_path}/sub dir/c.csv",), (f"file://{tmp_path}/ä+b.csv",)]


def test_pages_open_only_their_files(spark):
    from deklara.tables import Sorted, scope

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with scope(spark):
        df = spark.range(0, 1000, 1, 7).select((F.lit(999) - F.col("id")).alias("v"), F.col("id"))
        stored = Sorted(df, [F.col("v").asc()], "pos", 1)
        assert [(r["v"], r["pos"]) for r in stored.rows.orderBy("pos").collect()] == [(i, i + 1) for i in range(1000)]
        files = stored.index.count()
        assert files >= 3
        for first, count in ((1, 5), (300, 50), (996, 50), (1, 1000), (2000, 5)):
            page = stored.page(first, count)
            assert sorted(r["v"] for r in page.collect()) == [i - 1 for i in range(first, min(first + count, 1001))]
            opened = [f for f in page.inputFiles() if "/sorted-" in f and "/sorted-index" not in f]
            assert len(opened) < files or count == 1000 or first > 1000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
