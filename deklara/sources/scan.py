"""Declared text files as numbered records, without giving up splittable reading.

The text source cuts a file at the record delimiter, wherever its splits begin.  A delimiter inside an
encapsulated value does not end a record, so lines must be stitched; whether a line begins inside
a value depends on all lines before it, but only through one bit.  A line is a function of that bit, told
by two patterns: where it ends if entered outside, and if entered inside a value.  Functions compose.

Lines are shuffled once, by pieces of splits, which are some thousand lines each and called splits from here on.  There each
gets what it is under either bit of its split's begin: whether it is
inside a value, how many records begin up to it, and where its own record begins.  So they are written.  A split is then one
row: where it ends under either bit, its lines, bytes and records.  Going through these rows in order gives each split's
own bit and the numbers that it begins at; joined with the written lines they make the records' numbers.  Only rows of splits
are ordered over a whole file or table.

A record of more than ``RECORD_BYTES`` is not gathered: the row of the record has its first part, is marked as
``cut``, and ``record_parts`` has all of it in numbered parts.  So a capsule that is never closed costs no more than
other records.

Several tables of one layout are read together if ``tables`` (file, delivery, table_id, table) tells which file is whose.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from deklara.layout import Layout
from deklara.tables import _ROWS, with_small, written

# Declared codepages and Python's names for them.
CODEPAGES = {"ANSI": "cp1252", "OEM": "cp850", "Macintosh": "mac_roman", "UTF8": "utf-8", "UTF16": "utf-16-le"}
_UPPER = bytes(range(128, 256))
#: What tells the tables apart that are read together.
OWNER = ["delivery", "table_id", "table"]
#: Bytes of a record beyond which it is kept in parts.
RECORD_BYTES = 16 << 20
#: A split is taken in pieces of 2 ** PIECE lines, so that no task holds a split's lines at once.  A piece is known by its
#: split's first byte and its number in one ``block``; a split has fewer than 2 ** 33 lines.
PIECE = 14


def _upper(codepage: str) -> tuple[str, str]:
    """The upper half of a single-byte codepage: as ISO 8859-1 reads it, and as it is meant."""
    return _UPPER.decode("iso-8859-1"), _UPPER.decode(CODEPAGES[codepage], errors="replace")


def plain_path(path: Column) -> Column:
    """A file's path in the one form, whichever source gave it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:///")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Name (relative to the folder), length and path of every file below a folder; contents are not opened.

    The names come from the listing, as a scan passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").select(plain_path(F.col("file")).alias("file"))
    lengths = files.select(plain_path(F.col("_metadata.file_path")).alias("file"), "length")
    inner = F.regexp_extract("file", re.escape(root.rstrip("/").split(":", 1)[-1]) + "/(.+)$", 1)
    name = F.when(inner != "", inner).otherwise(F.element_at(F.split("file", "/"), -1))
    return listed.join(lengths, "file", "left").select(name.alias("name"), F.coalesce("length", F.lit(0).cast("bigint")).alias("length"), "file")


_PATTERN = re.compile(r"([][{}*?\\])")


def _literal(paths: str | list[str]) -> str | list[str]:
    """Names of files as Spark's readers take them: one path may be a pattern, those of a list are names."""
    return paths if isinstance(paths, str) else [_PATTERN.sub(r"\\\1", p) for p in paths]


def _owners(rows: DataFrame) -> list[str]:
    return [c for c in OWNER if c in rows.columns]


def _raw(spark: SparkSession, paths: str | list[str], delimiter: str, wide: bool) -> DataFrame:
    """The physical lines of files (path, block, at, value, bytes, size), where ``block`` is a piece of a split and ``at``
    orders its lines.  The path is as the source has it: ``plain_path`` is for fewer rows than lines."""
    reader = spark.read.option("lineSep", delimiter)
    text = (reader.option("encoding", "UTF-16LE") if wide else reader).text(_literal(paths))
    mark = len(delimiter.encode("utf-16-le" if wide else "utf-8"))
    text = text.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS)))
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        (F.shiftleft("_metadata.file_block_start", 33 - PIECE) + F.shiftright("at", PIECE)).alias("block"),
        "at",
        F.col("value").cast("binary").alias("value"),
        (F.octet_length("value") + mark).cast("bigint").alias("bytes"),
        F.col("_metadata.file_size").alias("size"),
    )


def _delimiter(layout: Layout) -> bytes:
    return layout.record_delimiter.encode("utf-16-le" if layout.codepage == "UTF16" else "utf-8")


def _split() -> WindowSpec:
    """The lines of a piece of a split in order."""
    return Window.partitionBy("path", "block").orderBy("at")


def _earlier() -> WindowSpec:
    """The piece's lines before this one."""
    return _split().rowsBetween(Window.unboundedPreceding, -1)


def _file() -> WindowSpec:
    """The file's pieces before this one."""
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _placed(rows: DataFrame, units: Column | None = None) -> DataFrame:
    """Lines with the byte of the file that they begin at (``from``).  What lies before a split comes from a pass over
    the files that keeps one row for each piece."""
    amount = F.col("bytes") if units is None else units
    blocks = rows.groupBy("path", "block").agg(F.sum(amount).alias("n"))
    blocks = written(blocks.select("path", "block", F.coalesce(F.sum("n").over(_file()), F.lit(0)).alias("before")), "split-bytes")
    within = F.coalesce(F.sum(amount).over(_earlier()), F.lit(0))
    rows = with_small(rows.withColumn("within", within), blocks, ["path", "block"])
    return rows.withColumn("from", F.col("before") + F.col("within")).drop("before", "within")


def _skipped(rows: DataFrame, layout: Layout) -> DataFrame:
    """Each file from byte ``skip_bytes`` on.  If that lies within a delimiter, what is left of it is text."""
    skip, mark = layout.skip_bytes, _delimiter(layout)
    start, end = F.col("from"), F.col("from") + F.col("bytes")
    left = F.substring(F.lit(mark), len(mark) - (F.col("over") - 1), F.col("over"))
    # The delimiter's bytes that are not skipped, for the line behind it or as a last line of their own.
    rest = F.when((start > skip) & (start < skip + len(mark)), start - skip).otherwise(0)
    last = (end == F.col("size")) & (end > skip) & (end < skip + len(mark))
    rows = rows.where((end >= skip + len(mark)) | last).withColumn("over", F.when(last & (start <= skip), end - skip).otherwise(rest).cast("int"))
    body = F.substring(F.col("value"), (F.greatest(F.lit(skip) - start, F.lit(0)) + 1).cast("int"), F.octet_length("value"))
    rows = rows.withColumn("value", F.concat(F.when(F.col("over") > 0, left).otherwise(F.lit(b"")), body))
    return rows.select(
        "path", "block", "at", "value", (F.octet_length("value") + len(mark)).cast("bigint").alias("bytes"),
        (F.col("size") - skip).alias("size"), F.greatest(start - skip - F.col("over"), F.lit(0)).alias("from"),
    )


def _aligned(rows: DataFrame, layout: Layout) -> DataFrame:
    """Lines of two-byte characters.  The bytes of a delimiter that begin at an odd place are halves of other
    characters, so the lines on both sides of them are one.  Such lines alone are gathered, by file."""
    whole = (F.col("from") % 2 == 0) & (F.col("bytes") % 2 == 0)
    own = Window.partitionBy("path").orderBy("from")
    parts = rows.where(~whole).withColumn("head", F.last(F.when(F.col("from") % 2 == 0, F.col("from")), True).over(own))
    parts = parts.groupBy("path", "head").agg(F.sort_array(F.collect_list(F.struct("from", "block", "at", "value", "bytes", "size"))).alias("p"))
    first = F.col("p")[0]
    value = F.aggregate(F.slice("p.value", 2, F.greatest(F.size("p") - 1, F.lit(0))), first["value"], lambda t, v: F.concat(t, F.lit(_delimiter(layout)), v))
    total = F.aggregate("p.bytes", F.lit(0).cast("bigint"), lambda t, n: t + n)
    joined = parts.select("path", first["block"].alias("block"), first["at"].alias("at"), value.alias("value"), total.alias("bytes"), first["size"].alias("size"), first["from"].alias("from"))
    return rows.where(whole).select(*joined.columns).unionAll(joined)


# Units of UTF-16 as pairs of characters of ISO 8859-1, the lower byte first: no surrogate, a pair of them, one alone.
_UNIT, _PAIR, _ALONE = r".[^Ø-ß]", r".[Ø-Û].[Ü-ß]", r".[Ø-ß]"
_SOUND = f"(?:{_UNIT}|{_PAIR})*+"


def _paired(value: Column) -> Column:
    """UTF-16 whose surrogates all come in pairs: one that is alone becomes U+FFFD."""
    units = F.decode(value, "ISO-8859-1")
    mended = F.encode(F.regexp_replace(units, rf"(?s)\G({_SOUND}){_ALONE}", "$1ýÿ"), "ISO-8859-1")
    return F.when(units.rlike(rf"(?s)\A{_SOUND}{_ALONE}"), mended).otherwise(value)


def decoded(value: Column, layout: Layout) -> Column:
    """Bytes as text, whatever the session's settings; bytes that the codepage does not know become U+FFFD.

    A single-byte codepage is ISO 8859-1 with other characters in its upper half.  Of UTF-16 a surrogate without
    its other half and an odd last byte become U+FFFD."""
    value = value.cast("binary")
    if layout.codepage == "UTF8":
        return F.make_valid_utf8(value.cast("string"))
    if layout.codepage == "UTF16":
        odd = F.octet_length(value) % 2 == 1
        even = F.substring(value, F.lit(1), (F.octet_length(value) - F.octet_length(value) % 2).cast("int"))
        text = F.decode(_paired(even), "UTF-16LE")
        return F.when(odd, F.concat(text, F.lit("�"))).otherwise(text)
    return F.translate(F.decode(value, "ISO-8859-1"), *_upper(layout.codepage))


def encoded(text: Column, codepage: str) -> Column:
    """Text as bytes of a single-byte codepage that has all its characters."""
    bytes_, meant = _upper(codepage)
    return F.encode(F.translate(text, meant, bytes_), "ISO-8859-1")


def without_mark(value: Column, first: Column) -> Column:
    """Drops a byte order mark from the first line."""
    return F.when(first, F.regexp_replace(value, "^﻿", "")).otherwise(value)


def _but(mark: str) -> str:
    """A pattern of any characters up to a mark of one or more characters."""
    return f"[^{re.escape(mark)}]*+" if len(mark) == 1 else f"(?:(?!{re.escape(mark)}).)*+"


def _field(layout: Layout) -> tuple[str, str, str]:
    """Patterns of the rest of an encapsulated value, of any value, and of what follows one."""
    q, s = re.escape(layout.encapsulator), re.escape(layout.column_delimiter)
    body, bare = _but(layout.encapsulator), _but(layout.column_delimiter)
    rest = f"{body}(?:{q}{q}{body})*+{q}{bare}"
    value = f"(?:{q}{rest}|(?!{q}){bare})"
    return rest, value, f"(?:{s}{value})*+"


def _by_bit(zero: str | Column, one: str | Column, bit: Column) -> Column:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(bit == 1, as_column(one)).otherwise(as_column(zero))


def lines(spark: SparkSession, paths: str | list[str], layout: Layout) -> DataFrame:
    """The files' physical lines, each as it is under either bit of its split's begin, without the bytes that the
    layout skips: (path, block, n, within, bytes, size, value, in0, in1, out0, out1, starts0, starts1, head0, head1).

    ``n`` is the line's number in its split and ``within`` the split's bytes before it.  ``in`` and ``out`` say whether
    the line begins and ends inside a value, ``starts`` how many records begin up to it, ``head`` where in the split its
    record begins, null if in an earlier one."""
    wide = CODEPAGES[layout.codepage] == "utf-16-le"
    rows = _raw(spark, paths, layout.record_delimiter, wide)
    if layout.skip_bytes or wide:
        rows = _placed(rows)
        rows = _skipped(rows, layout) if layout.skip_bytes else rows
        rows = (_aligned(rows, layout) if wide else rows).drop("from")
    rows = rows.withColumn("value", decoded(F.col("value"), layout))
    within = F.coalesce(F.sum("bytes").over(_earlier()), F.lit(0))
    rows = rows.withColumn("n", F.row_number().over(_split()).cast("bigint")).withColumn("within", within)
    if layout.encapsulator:
        rest, value, more = _field(layout)
        ends = lambda pattern: F.when(F.col("value").rlike(rf"(?s)\A{pattern}{more}\z"), 0).otherwise(1)
        rows = rows.withColumn("f0", ends(value)).withColumn("f1", ends(rest))
        flip = F.when((F.col("f0") == 1) & (F.col("f1") == 0), 1).otherwise(0)
        rows = rows.withColumn("flips", F.coalesce(F.sum(flip).over(_earlier()), F.lit(0)))
        fixed = F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("bit"), F.col("flips").alias("flips")))
        rows = rows.withColumn("last", F.last(fixed, True).over(_earlier()))
        at_entry = lambda bit: F.when(F.col("last").isNotNull(), F.col("last.bit") + F.col("flips") - F.col("last.flips")).otherwise(F.col("flips") + bit) % 2
        rows = rows.withColumn("in0", at_entry(0).cast("int")).withColumn("in1", at_entry(1).cast("int"))
    else:
        rows = rows.withColumn("f0", F.lit(0)).withColumn("f1", F.lit(0)).withColumn("in0", F.lit(0)).withColumn("in1", F.lit(0))
    upto = _split().rowsBetween(Window.unboundedPreceding, 0)
    more = []
    for bit in "01":
        begins = F.col(f"in{bit}") == 0
        more += [
            _by_bit("f0", "f1", F.col(f"in{bit}")).alias(f"out{bit}"), F.sum(F.when(begins, 1).otherwise(0)).over(upto).alias(f"starts{bit}"),
            F.max(F.when(begins, F.col("within"))).over(upto).alias(f"head{bit}"),
        ]
    return written(rows.select("path", "block", "n", "within", "bytes", "size", "value", "in0", "in1", *more), "lines")


def _splits(raw: DataFrame, tables: DataFrame | None) -> DataFrame:
    """One row for each split: the bit it is entered with, and the line, record and byte that it begins at."""
    last = [F.max_by(f"out{b}", "n").alias(f"out{b}") for b in "01"] + [F.max(f"{c}{b}").alias(f"{c}{b}") for c in ("starts", "head") for b in "01"]
    splits = raw.groupBy("path", "block").agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"), *last)
    # A split fixes the bit, or leaves it as it is or the other way round.
    flip = F.when((F.col("out0") == 1) & (F.col("out1") == 0), 1).otherwise(0)
    splits = splits.withColumn("flips", F.coalesce(F.sum(flip).over(_file()), F.lit(0)))
    after = F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").alias("bit"), (F.col("flips") + flip).alias("flips")))
    splits = splits.withColumn("known", F.last(after, True).over(_file()))
    entry = F.when(F.col("known").isNotNull(), F.col("known.bit") + F.col("flips") - F.col("known.flips")).otherwise(F.col("flips")) % 2
    splits = splits.withColumn("entry", entry.cast("int")).withColumn("before", F.coalesce(F.sum("bytes").over(_file()), F.lit(0)))
    splits = splits.withColumn("starts", _by_bit("starts0", "starts1", F.col("entry"))).withColumn("head", F.col("before") + _by_bit("head0", "head1", F.col("entry")))
    splits = splits.withColumn("total", F.sum("bytes").over(Window.partitionBy("path"))).withColumn("earlier_head", F.max("head").over(_file()))
    splits = splits.withColumn("file", plain_path(F.col("path")))
    if tables is not None:  # a file that two tables declare is read for both
        splits = splits.join(tables.select("file", *OWNER), "file")
    who = [c for c in OWNER[:2] if c in splits.columns]
    table = Window.partitionBy(*who).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    return splits.select(
        "path", "block", "file", *_owners(splits), "entry", "before", (F.col("total") == F.col("size")).alias("ends"), "total", "earlier_head",
        F.coalesce(F.sum("n").over(table), F.lit(0)).alias("first_line"), F.coalesce(F.sum("starts").over(table), F.lit(0)).alias("first_record"),
    )


def numbered_lines(raw: DataFrame, layout: Layout, tables: DataFrame | None = None) -> DataFrame:
    """Lines with ``inside`` (entered within a value), ``leaves`` (left within one), ``record`` and ``line`` numbers from 1,
    ``offset`` (bytes of the record before the line) and ``final`` (the file's last).  The files of a table are taken in the
    order of their names; a value never spans files."""
    splits = written(_splits(raw, tables), "splits")
    rows = with_small(raw, splits, ["path", "block"])
    pick = lambda name: _by_bit(f"{name}0", f"{name}1", F.col("entry"))
    at = F.col("before") + F.col("within")
    return rows.select(
        *_owners(rows), F.col("file").alias("path"), (F.col("first_record") + pick("starts")).alias("record"), (F.col("first_line") + F.col("n")).alias("line"),
        (pick("in") == 1).alias("inside"), (pick("out") == 1).alias("leaves"), "ends", (at + F.col("bytes") >= F.col("total")).alias("final"),
        (at - F.coalesce(F.col("before") + pick("head"), F.col("earlier_head"), F.lit(0))).alias("offset"), "bytes", "value",
    )


def _gathered(numbered: DataFrame, layout: Layout, most: int) -> DataFrame:
    """Lines of records of several lines, joined to parts that begin within ``most`` bytes each."""
    several = numbered.where(F.col("inside") | F.col("leaves")).withColumn("part", F.floor(F.col("offset") / most).cast("bigint"))
    parts = several.groupBy(*_owners(numbered), "path", "record", "part").agg(
        F.sort_array(F.collect_list(F.struct("line", "value", "leaves", "final"))).alias("lines"), F.max("ends").alias("ends")
    )
    last = F.element_at("lines", -1)
    return parts.select(
        *_owners(numbered), "path", F.col("record").alias("_ordinal"), "part", "lines", last["leaves"].alias("open"), last["final"].alias("final"),
        F.concat(F.array_join(F.col("lines.value"), layout.record_delimiter), F.when(last["leaves"] & (~last["final"] | F.col("ends")), F.lit(layout.record_delimiter)).otherwise(F.lit(""))).alias("value"),
    )


def record_parts(numbered: DataFrame, layout: Layout, most: int = RECORD_BYTES) -> DataFrame:
    """All text of records of several lines, in parts (path, _ordinal, part, value) that follow each other: a part
    begins with the first line that begins behind another ``most`` bytes."""
    return _gathered(numbered, layout, most).select(*_owners(numbered), "path", "_ordinal", "part", "value")


def stitched(numbered: DataFrame, layout: Layout, most: int = RECORD_BYTES) -> DataFrame:
    """One row per record: (path, _ordinal, value, unterminated, cut, more).  Only lines of records that span
    several are shuffled.  A value that the file never closes keeps the delimiter that ends the file.

    A record of more than ``most`` bytes has its first part here, is ``cut``, and ``more`` counts the values that begin
    behind that part."""
    none = F.lit(0).cast("bigint").alias("more")
    names = [*_owners(numbered), "path", "_ordinal", "value", "unterminated", "cut", "more"]
    single = numbered.where(~F.col("inside") & ~F.col("leaves")).withColumns({"_ordinal": F.col("record"), "unterminated": F.lit(False), "cut": F.lit(False), "more": none})
    if not layout.encapsulator:
        return single.select(*names)
    parts = _gathered(numbered, layout, most)
    key = [*_owners(numbered), "path", "_ordinal"]
    begun = F.aggregate("lines.value", F.lit(0).cast("bigint"), lambda n, v: n + F.size(split_record(F.concat(F.lit(layout.encapsulator), v), layout)) - 1)
    behind = parts.where("part > 0").groupBy(*key).agg(F.max_by("open", "part").alias("still"), F.sum(begun).alias("begun"))
    # Only parts that the record goes on behind are joined: as a rule none.
    ended = ~F.col("open") | F.col("final")
    first = parts.where("part = 0")
    whole = first.where(ended).select(*key, "value", F.col("open").alias("unterminated"), F.lit(False).alias("cut"), none)
    rest = first.where(~ended).join(behind, key).select(*key, "value", F.col("still").alias("unterminated"), F.lit(True).alias("cut"), F.col("begun").alias("more"))
    return single.select(*names).unionByName(whole).unionByName(rest)


def split_record(value: Column, layout: Layout) -> Column:
    """The values of one record: an encapsulated value without its capsule, doubled ones as one, and
    what stands behind it kept."""
    if not layout.encapsulator:
        return F.split(value, re.escape(layout.column_delimiter), -1)
    q, s = re.escape(layout.encapsulator), re.escape(layout.column_delimiter)
    rest, one, _ = _field(layout)
    body = _but(layout.encapsulator)
    open_end = f"{q}{body}(?:{q}{q}{body})*+\\z"
    found = F.regexp_extract_all(F.concat(F.lit(layout.column_delimiter), value), F.lit(f"(?s){s}({open_end}|{one})"), F.lit(1))
    whole = rf"(?s)\A{q}({body}(?:{q}{q}{body})*+)(?:{q}(.*))?\z"
    twice = layout.encapsulator * 2

    def plain(v: Column) -> Column:
        inner = F.replace(F.regexp_extract(v, whole, 1), F.lit(twice), F.lit(layout.encapsulator))
        return F.when(v.startswith(layout.encapsulator), F.concat(inner, F.regexp_extract(v, whole, 2))).otherwise(v)

    return F.transform(found, plain)


def shaped(records: DataFrame, layout: Layout, parts: Column) -> DataFrame:
    """``_ordinal`` and exactly the declared columns: missing ones empty, further ones dropped, with
    the number of values that the record had."""
    cells = (F.coalesce(F.get(F.col("_parts"), F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(layout.columns)))
    there = [c for c in ("unterminated", "cut") if c in records.columns]
    n = F.size("_parts") + (F.col("more").cast("int") if "more" in records.columns else F.lit(0))
    return records.withColumn("_parts", parts).select(*_owners(records), "_ordinal", *cells, n.alias("n_values"), *there)


def in_range(records: DataFrame, layout: Layout) -> DataFrame:
    """Records of the declared range; numbers still count from the file's first record."""
    rows = records.where(F.col("_ordinal") >= layout.first_record)
    return rows if layout.last_record is None else rows.where(F.col("_ordinal") <= layout.last_record)


def scan_delimited(spark: SparkSession, paths: str | list[str], layout: Layout, tables: DataFrame | None = None, most: int = RECORD_BYTES) -> DataFrame:
    """A delimited file's records: _ordinal, c0.., n_values, unterminated, cut."""
    records = stitched(numbered_lines(lines(spark, paths, layout), layout, tables), layout, most)
    records = records.withColumn("value", without_mark(F.col("value"), F.col("_ordinal") == 1))
    return in_range(shaped(records, layout, split_record(F.col("value"), layout)), layout)


def scan_fixed(spark: SparkSession, paths: str | list[str], layout: Layout, tables: DataFrame | None = None) -> DataFrame:
    """A fixed-length file's records: values cut at the declared spans, and the record's length.

    Without a record delimiter a record ends after the declared length."""
    if layout.record_delimiter:
        plain = replace(layout, encapsulator="")
        raw = numbered_lines(lines(spark, paths, plain), plain, tables).withColumn("_ordinal", F.col("record"))
    else:
        raw = _undelimited(spark, paths, layout, tables)
    raw = raw.withColumn("value", without_mark(F.col("value"), F.col("_ordinal") == 1))
    cells = (F.coalesce(F.substring("value", c.start, c.end - c.start + 1), F.lit("")).alias(f"c{i}") for i, c in enumerate(layout.columns))
    return in_range(raw.select(*_owners(raw), "_ordinal", *cells, F.length("value").alias("n_chars")), layout)


def _undelimited(spark: SparkSession, paths: str | list[str], layout: Layout, tables: DataFrame | None) -> DataFrame:
    """Records (_ordinal, value) of files that nothing but the declared length cuts.

    Characters of one width: if the records' bytes divide every file, Spark's reader of binary records takes them, split by
    split, and a record's number follows from its place.  Else the text source ends lines at line feeds, which are characters
    like others; the lines of a piece are put together again to one chunk, and how many bytes (of UTF-8: characters) lie
    before a chunk tells which records it holds parts of.
    A line is one cell, so a file of over 2 GB that holds no line feed cannot be read in this way."""
    chars = layout.codepage == "UTF8"
    width = layout.record_length * (2 if layout.codepage == "UTF16" else 1)
    files = spark.read.format("binaryFile").load(_literal(paths)).select(plain_path(F.col("_metadata.file_path")).alias("path"), "length").where("length > 0")
    odd = not isinstance(paths, str) and any(_PATTERN.search(p) or "," in p for p in paths)  # the reader of binary records takes one pattern
    if not chars and not layout.skip_bytes and not odd and files.where(F.col("length") % width != 0).isEmpty():
        files = written(files.withColumn("n", F.floor(F.col("length") / width)), "fixed-files")
        rows = _binary_records(spark, [r["path"] for r in files.select("path").collect()], width)  # one layout's files
        records = rows.select("path", "r", decoded(F.col("value"), layout).alias("value"))
        return _by_file(records, files, tables)
    raw = _chunks(spark, paths)
    # The line feed is a byte like any other, but for the one that the file's end lacks; bytes are counted with it.
    if layout.skip_bytes:
        rows = _placed(raw)
        chunk = F.when(F.col("from") + F.col("bytes") <= F.col("size"), F.concat("value", F.lit(b"\n"))).otherwise(F.col("value"))
        cut = F.greatest(F.lit(layout.skip_bytes) - F.col("from"), F.lit(0)).cast("int")
        rows = rows.select("path", "block", "at", F.substring(chunk, cut + 1, F.octet_length("value") + 1).alias("value"))
    else:
        cells = [(F.sum("bytes") == F.max("size")).alias("ends"), F.min("block").alias("first"), F.max("block").alias("last")]
        rows = with_small(raw, written(raw.groupBy("path").agg(*cells), "file-ends"), ["path"])
        final = (F.col("block") == F.col("last")) & ~F.col("ends")
        value = F.when(final, F.col("value")).otherwise(F.concat("value", F.lit(b"\n")))
        rows = rows.select("path", "block", "at", value.alias("value"), (F.col("block") == F.col("first")).alias("opens"))
    if chars:
        rows = rows.withColumn("value", decoded(F.col("value"), layout))
        rows = rows if layout.skip_bytes else rows.withColumn("value", without_mark(F.col("value"), F.col("opens")))
    size = F.length if chars else F.octet_length
    rows = _placed(rows.where(size("value") > 0).withColumn("units", size("value").cast("bigint")), F.col("units"))
    # What completes an earlier record, the records that begin here, and their places.
    head = (F.lit(width) - F.col("from") % width) % width
    head = F.least(head, F.col("units")).cast("int")
    body = F.substring("value", head + 1, size("value").cast("int"))
    if chars:
        pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    else:
        count = F.ceil((F.col("units") - head) / width).cast("int")
        pieces = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda k: F.substring(body, (k - 1) * width + 1, F.lit(width)))).otherwise(F.array().cast("array<binary>"))
    before = F.struct(F.floor(F.col("from") / width).alias("r"), F.substring("value", F.lit(1), head).alias("piece"))
    begun = F.transform(pieces, lambda p, k: F.struct((F.ceil(F.col("from") / width) + k).alias("r"), p.alias("piece")))
    kept = F.when(head > 0, F.concat(F.array(before), begun)).otherwise(begun)
    cut = rows.select("path", F.col("from").alias("at"), F.explode(kept).alias("p")).select("path", "at", F.col("p.r").alias("r"), F.col("p.piece").alias("value"))
    full = size("value") == width
    parts = cut.where(~full).groupBy("path", "r").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p"))
    empty = F.lit("") if chars else F.lit(b"")
    joined = parts.select("path", "r", F.aggregate("p.value", empty, lambda t, v: F.concat(t, v)).alias("value"))
    records = cut.where(full).select("path", "r", "value").unionByName(joined)
    records = written(records if chars else records.withColumn("value", decoded(F.col("value"), layout)), "fixed")
    return _by_file(records, written(records.groupBy("path").agg((F.max("r") + 1).alias("n")), "fixed-files"), tables)


def _chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The files in rows of ``_raw``, one for each piece of a split: its lines with the line feeds between them."""
    rows = _raw(spark, paths, "\n", False)
    lines = F.sort_array(F.collect_list(F.struct("at", F.col("value").cast("string").alias("value"))))
    rows = rows.groupBy("path", "block").agg(lines.alias("lines"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    value = F.array_join("lines.value", "\n").cast("binary").alias("value")
    return written(rows.select(plain_path(F.col("path")).alias("path"), "block", F.lit(0).cast("bigint").alias("at"), value, "bytes", "size"), "chunks")


def _binary_records(spark: SparkSession, paths: list[str], width: int) -> DataFrame:
    """(path, r, value): records of ``width`` bytes with their number in the file, from 0.  Splits begin at records."""
    context = spark.sparkContext
    if not paths:
        return spark.createDataFrame([], "path string, r bigint, value binary")
    found = context._jsc.binaryRecords(",".join(paths), width)
    rows = DataFrame(spark._jsparkSession.createDataset(found.rdd(), context._jvm.org.apache.spark.sql.Encoders.BINARY()), spark)
    place = F.expr("input_file_block_start()") / width + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))
    return rows.select(plain_path(F.input_file_name()).alias("path"), place.cast("bigint").alias("r"), "value")


def _by_file(records: DataFrame, files: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Records numbered over the files of each table, in the order of their names."""
    if tables is not None:
        files = files.join(tables.select(F.col("file").alias("path"), *OWNER), "path")
    who = [c for c in OWNER[:2] if c in files.columns]
    table = Window.partitionBy(*who).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = written(files.select("path", *_owners(files), F.coalesce(F.sum("n").over(table), F.lit(0)).alias("before")), "file-starts")
    return with_small(records, starts, ["path"]).select(*_owners(starts), (F.col("before") + F.col("r") + 1).alias("_ordinal"), "value")


def undecodable(records: DataFrame, layout: Layout) -> DataFrame:
    """Records with a replacement character, and the first column that has one."""
    columns = F.array(*(F.contains(f"c{i}", F.lit("�")) for i in range(len(layout.columns))))
    return records.select("_ordinal", (F.array_position(columns, True) - 1).alias("column_index")).where("column_index >= 0")


def header(records: DataFrame, layout: Layout) -> DataFrame:
    """What the first record is: the declared names in order, in another order, or neither."""
    names = F.array(*(F.lit(c.name) for c in layout.columns))
    first = F.array(*(F.btrim(F.col(f"c{i}")) for i in range(len(layout.columns))))
    kind = F.when(first == names, "header").when(F.sort_array(first) == F.sort_array(names), "other order").otherwise("data")
    return records.where("_ordinal = 1").select("_ordinal", kind.alias("kind"))


def unusable(layout: Layout) -> str | None:
    """Why a declaration gives no reading, or None."""
    if not layout.columns:
        return "no format"
    if layout.codepage not in CODEPAGES:
        return "codepage"
    if layout.record_length is None and not (layout.column_delimiter and layout.record_delimiter):
        return "empty delimiter"
    if layout.record_length is not None and layout.record_length <= 0 and not layout.record_delimiter:
        return "zero length"
    if layout.record_length is not None and any(c.start is None or c.end is None or not 1 <= c.start <= c.end for c in layout.columns):
        return "bad span"
    return None
