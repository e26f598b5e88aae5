"""Scans against a reader written character by character."""

import random
from dataclasses import replace

import pytest

from deklara.layout import Column, Layout
from deklara.sources import scan

LAYOUT = Layout("T", tuple(Column(n) for n in "abc"), record_delimiter="\n", codepage="UTF8")


def brute(text):
    """Records of a text: the reading that a tokenizer gives."""
    records, values, cell, inside, start = [], [], "", False, True
    i = 0
    while i < len(text):
        ch = text[i]
        if inside:
            if ch == '"' and text[i + 1 : i + 2] == '"':
                cell += '"'
                i += 1
            elif ch == '"':
                inside = False
            else:
                cell += ch
        elif ch == '"' and start:
            inside = True
        elif ch == ";":
            values.append(cell)
            cell, start = "", True
            i += 1
            continue
        elif ch == "\n":
            records.append([*values, cell])
            values, cell, start = [], "", True
            i += 1
            continue
        else:
            cell += ch
        start = False
        i += 1
    if values or cell or not start:
        records.append([*values, cell])
    return records


def read(spark, tmp_path, text, block=None):
    path = tmp_path / "t.txt"
    path.write_bytes(text.encode())
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
    try:
        raw = scan.lines(spark, str(path), LAYOUT)
        records = scan.stitched(scan.numbered_lines(raw, LAYOUT), LAYOUT)
        rows = records.select("_ordinal", scan.split_record(records["value"], LAYOUT).alias("v")).orderBy("_ordinal").collect()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert [r["_ordinal"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["v"] for r in rows]


@pytest.mark.parametrize("text", ['a;b;c\n', 'a;"b;c";d\n', '"a\nb";c\n', '"a""b";c\n', '"a"b;c\n', 'a"b;c\nd;e\n', '"";;x\n', ';;\n', 'x;"open\nrest', '"a";"b"\n"c\n\n";d\n'])
def test_dialect(spark, tmp_path, text):
    assert read(spark, tmp_path, text) == brute(text)


def test_adversarial_over_many_splits(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(rng.choice(['"', '"', ";", "\n", "a", "bc", '""', ';"', '"\n']) for _ in range(1500)) + '"\n'
    expected = brute(text)
    assert read(spark, tmp_path, text, block=97) == expected


def test_record_range_and_shape(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("a\nb;1\nc;2;3;4\n")
    rows = scan.scan_delimited(spark, str(path), replace(LAYOUT, first_record=2)).orderBy("_ordinal").collect()
    assert [tuple(r[:5]) for r in rows] == [(2, "b", "1", "", 2), (3, "c", "2", "3", 4)]


def test_unusable():
    assert scan.unusable(LAYOUT) is None and scan.unusable(replace(LAYOUT, codepage="UTF7")) == "codepage"


def scanned(spark, path, layout, block=None):
    if block:
        for key, v in (("maxPartitionBytes", block), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            spark.conf.set(f"spark.sql.files.{key}", v)
    try:
        rows = scan.scan_delimited(spark, str(path), layout).orderBy("_ordinal").collect()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum") if block else ():
            spark.conf.unset(f"spark.sql.files.{key}")
    assert [r["_ordinal"] for r in rows] == list(range(1, len(rows) + 1))
    return [[r["c0"], r["c1"], r["c2"]] for r in rows]


def shaped(records):
    return [[*r, "", ""][:3] for r in records]


@pytest.mark.parametrize("skip", [2, 5, 6, 7, 8, 9, 30, 1000])
def test_skipped_bytes_of_several_files(spark, tmp_path, skip):
    """Bytes go from each file; what is left is stitched and numbered over all files."""
    texts = ['12345\r\n\r\n"a;\r\nb";c\r\nd;"e\r\n"\r\n', '#HEAD#x;"y\r\n\r\nz"\r\nlast;1']
    for i, t in enumerate(texts):
        (tmp_path / f"p{i}.txt").write_bytes(t.encode())
    # The brute reader knows one character as delimiter; other line feeds are told apart from it.
    bodies = [t[skip:].replace("\r\n", "\1").replace("\n", "\2").replace("\1", "\n") for t in texts]
    expected = [[v.replace("\n", "\r\n").replace("\2", "\n") for v in r] for b in bodies for r in brute(b)]
    for block in (None, 11):
        assert scanned(spark, tmp_path, replace(LAYOUT, record_delimiter="\r\n", skip_bytes=skip), block) == shaped(expected)


def test_marks_of_several_characters(spark, tmp_path):
    layout = replace(LAYOUT, encapsulator="<<", column_delimiter="||")
    (tmp_path / "m.txt").write_text("a<b||<<x||y\n<<<<z<<||c\n<<q<<||<||<<<<\n")
    assert scanned(spark, tmp_path / "m.txt", layout) == [["a<b", "x||y\n<<z", "c"], ["q", "<", ""]]


@pytest.mark.parametrize("delimiter", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [None, 13])
def test_utf16(spark, tmp_path, delimiter, block):
    """Halves of characters that look like a delimiter are none: \u0a05\u0100 holds the bytes 0A 00."""
    text = '\ufeffGr\u00f6\u00dfe;"a\nb";1\n\u0a05\u0100;x\u0a85\u0a00\u2000;\u0d05\u0a00\u0100\n;\u20ac\nend;"\U0001f600\n\n"'
    (tmp_path / "u.txt").write_bytes(text.replace("\n", delimiter).encode("utf-16-le"))
    expected = [[v.replace("\n", delimiter) for v in r] for r in shaped(brute(text[1:]))]
    assert scanned(spark, tmp_path / "u.txt", replace(LAYOUT, record_delimiter=delimiter, codepage="UTF16"), block) == expected


@pytest.mark.parametrize(("codepage", "charset"), [("OEM", "cp850"), ("Macintosh", "mac-roman"), ("ANSI", "cp1252")])
def test_single_byte_codepages(spark, tmp_path, codepage, charset):
    (tmp_path / "s.txt").write_bytes('Größe;"ä\nß";é\n'.encode(charset))
    assert scanned(spark, tmp_path / "s.txt", replace(LAYOUT, codepage=codepage)) == [["Größe", "ä\nß", "é"]]


def units(*texts):
    """UTF-16 of texts; a number is a unit of its own, such as half a surrogate pair."""
    return b"".join(t.to_bytes(2, "little") if isinstance(t, int) else t.encode("utf-16-le") for t in texts)


@pytest.mark.parametrize("block", [None, 14])
def test_utf16_with_lone_surrogates(spark, tmp_path, block):
    """Whatever is no pair is U+FFFD, and found; the records before and behind stay as they are."""
    from deklara.operators import conformance as N

    (tmp_path / "u.txt").write_bytes(units("ab;2\n", 0xD800, ";Ø߿ß\n", "x", 0xDC00, 0xD83D, 0xD83D, 0xDE00, "y;\U0001f600", 0xDE00, "\nend;", 0xDBFF))
    layout = replace(LAYOUT, codepage="UTF16")
    expected = [["ab", "2", ""], ["\ufffd", "Ø߿ß", ""], ["x\ufffd\ufffd\U0001f600y", "\U0001f600\ufffd", ""], ["end", "\ufffd", ""]]
    assert scanned(spark, tmp_path / "u.txt", layout, block) == expected
    found = N.record_findings(scan.scan_delimited(spark, str(tmp_path / "u.txt"), layout), layout).where("code = '4005'")
    assert sorted((r["_ordinal"], r["column"]) for r in found.collect()) == [(2, "a"), (3, "a"), (4, "b")]


def test_lone_surrogates_against_a_lenient_decoder(spark):
    rng = random.Random(7)
    values = [bytes(rng.choice([0xD8, 0xDC, 0xDF, 0x00, 0x41, 0xFF]) for _ in range(2 * rng.randint(0, 12))) for _ in range(400)]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary")
    got = {r["i"]: r["t"] for r in found.select("i", scan.decoded(found["v"], replace(LAYOUT, codepage="UTF16")).alias("t")).collect()}

    def lenient(v):
        u, out, i = [int.from_bytes(v[k : k + 2], "little") for k in range(0, len(v), 2)], "", 0
        while i < len(u):
            if 0xD800 <= u[i] < 0xDC00 and i + 1 < len(u) and 0xDC00 <= u[i + 1] < 0xE000:
                out, i = out + chr(0x10000 + ((u[i] - 0xD800) << 10) + u[i + 1] - 0xDC00), i + 2
            else:
                out, i = out + ("\ufffd" if 0xD800 <= u[i] < 0xE000 else chr(u[i])), i + 1
        return out

    assert [got[i] for i in range(len(values))] == [lenient(v) for v in values]


@pytest.mark.parametrize("block", [None, 300])
@pytest.mark.parametrize("closed", [True, False])
def test_a_record_beyond_the_bound_is_kept_in_parts(spark, tmp_path, block, closed):
    """A capsule opened in the first line of a file: bounded cells, right numbers, right count of values, nothing lost."""
    from deklara.operators import conformance as N

    inner = "".join(f'line {i};"" still\n' for i in range(200))
    text = 'a;b\nk;"' + inner + ('";t;u;v\nlast;1;2\n' if closed else "")
    (tmp_path / "t.txt").write_text(text)
    for key, v in (("maxPartitionBytes", block), ("openCostInBytes", 0), ("minPartitionNum", 1)) if block else ():
        spark.conf.set(f"spark.sql.files.{key}", v)
    try:
        numbered = scan.numbered_lines(scan.lines(spark, str(tmp_path / "t.txt"), LAYOUT), LAYOUT)
        parts = scan.record_parts(numbered, LAYOUT, 500).orderBy("_ordinal", "part").collect()
        rows = {r["_ordinal"]: r for r in scan.scan_delimited(spark, str(tmp_path / "t.txt"), LAYOUT, most=500).collect()}
        found = N.record_findings(scan.scan_delimited(spark, str(tmp_path / "t.txt"), LAYOUT, most=500), LAYOUT).collect()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert sorted(rows) == ([1, 2, 3] if closed else [1, 2]) and (rows[1]["c0"], rows[1]["cut"]) == ("a", False)
    assert [p["part"] for p in parts] == list(range(len(parts))) and len(parts) > 5
    assert max(len(p["value"]) for p in parts) < 560 and "".join(p["value"] for p in parts) == text[4:].removesuffix("last;1;2\n").removesuffix("v\n") + ("v" if closed else "")
    assert rows[2]["cut"] and rows[2]["c0"] == "k" and rows[2]["c1"].startswith('line 0;" still\nline 1') and len(rows[2]["c1"]) < 560
    assert (rows[2]["n_values"], rows[2]["unterminated"]) == ((5, False) if closed else (2, True))
    assert {r["code"] for r in found if r["_ordinal"] == 2} == ({"4004"} if closed else {"4004", "4006"})
    if closed:
        assert [rows[3][c] for c in ("c0", "c1", "c2", "cut")] == ["last", "1", "2", False]


def test_one_exchange_of_lines(spark, tmp_path):
    """Lines are shuffled once, before they are written; records are made from them without another exchange of lines."""
    (tmp_path / "t.txt").write_text("a;b;c\n" * 50)
    exchanges = []
    whole, scan.written = scan.written, lambda df, name: (exchanges.append((name, df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString())), whole(df, name))[1]
    try:
        numbered = scan.numbered_lines(scan.lines(spark, str(tmp_path / "t.txt"), LAYOUT), LAYOUT)
    finally:
        scan.written = whole
    by_name = {n: p for n, _, p in exchanges}
    assert by_name["lines"].count("Exchange hashpartitioning(path") == 1
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


FIXED = Layout("F", (Column("A", start=1, end=3), Column("B", start=4, end=7)), record_delimiter="", codepage="UTF8", record_length=7)


@pytest.mark.parametrize(
    "codepage, charset, skip, tail",
    [("UTF8", "utf-8", 0, ""), ("UTF8", "utf-8", 0, "zz"), ("UTF8", "utf-8", 6, "\n"), ("ANSI", "cp1252", 0, ""), ("ANSI", "cp1252", 6, "zz"), ("UTF16", "utf-16-le", 0, "\n"), ("UTF16", "utf-16-le", 6, "")],
)
def test_fixed_over_many_splits(spark, tmp_path, codepage, charset, skip, tail):
    """Records that nothing but their length cuts, from several files in splits of a few bytes, line feeds in them."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc\näöß€ ") for _ in range(7 * 40)) + tail for _ in range(3)]
    for i, t in enumerate(texts):
        (tmp_path / f"p{i}.txt").write_bytes(b"#" * skip + t.encode(charset))
    layout = replace(FIXED, codepage=codepage, skip_bytes=skip)
    for key, v in (("maxPartitionBytes", 50), ("openCostInBytes", 0), ("minPartitionNum", 1)):
        spark.conf.set(f"spark.sql.files.{key}", v)
    try:
        read = scan.scan_fixed(spark, str(tmp_path), layout)
        assert "Python" not in read._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in read.orderBy("_ordinal").collect()]
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    cut = [t[i : i + 7] for t in texts for i in range(0, len(t), 7)]
    assert got == [(n + 1, r[:3], r[3:], len(r)) for n, r in enumerate(cut)]
