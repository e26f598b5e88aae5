"""Checks over the declarations of many deliveries, as relational jobs over catalog tables.

A declared table is known by ``delivery`` and ``table_id``, never by its name: names may repeat.  ``table`` is what it is
called, its name or else its location; references name tables so, and ``resolved`` tells what they mean.

Catalog tables, each with ``delivery``:

* ``tables``: table_id, table, name, url, description, medium_id, medium, fixed, pk_count, decimal, grouping, column_delimiter,
  record_delimiter, encapsulator, skip_bytes, epoch, range_from, range_to, range_length, record_length, validity_mask
* ``columns``: table_id, table, pos, name, kind, is_pk, mask, span_from, span_to, description, accuracy, implied, max_length
* ``maps``: table_id, table, name, kind, map_from, map_to
* ``fks``: table_id, table, fk, parent · ``fk_columns``: table_id, table, fk, pos, name · ``aliases``: table_id, table, fk, pos, source, target
* ``media``: medium_id, medium, accepted · ``entries``: name · ``extensions``: name, url · ``commands``: name

Every check returns (delivery, table, code, severity, subject); ``table`` is empty for what concerns no single table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deklara.layout import DATE, TEXT

# Severities of the structure checks that are not errors.
SEVERITIES = {3010: "warning", 3011: "warning", 3013: "warning", 3014: "info", 3016: "warning", 3017: "info", 3024: "warning", 3025: "warning", 3027: "warning", 3028: "info", 3029: "warning", 3030: "info", 1006: "warning"}
# Characters that names may not hold, and the longest description.
RESERVED = '["&<>]'
LONGEST_DESCRIPTION = 255
TIME_MASK = r"\AHH[^A-Za-z0-9]?MM([^A-Za-z0-9]?SS)?([^A-Za-z0-9]?TT)?\z"

TABLE = ["delivery", "table_id"]
KEY = [*TABLE, "fk"]


def _found(rows: DataFrame, code: int, subject: Column | str, severity: Column | None = None, about: bool = True) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    level = F.lit(SEVERITIES.get(code, "error")) if severity is None else severity
    table = F.col("table") if about else F.lit("")
    return rows.select("delivery", table.alias("table"), F.lit(str(code)).alias("code"), level.alias("severity"), subject.cast("string").alias("subject"))


def resolved(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys with ``matches``, how many tables of the delivery are called what they reference, and if it is one,
    ``parent_id`` and ``parent_keys``, the number of its key columns."""
    named = tables.groupBy("delivery", F.col("table").alias("parent")).agg(F.count("*").alias("n"), F.min("table_id").alias("_id"), F.min("pk_count").alias("_keys"))
    joined = fks.join(named, ["delivery", "parent"], "left").withColumn("matches", F.coalesce("n", F.lit(0)))
    one = lambda c: F.when(F.col("matches") == 1, F.col(c))
    return joined.select(*(c for c in fks.columns), "matches", one("_id").alias("parent_id"), one("_keys").alias("parent_keys"))


def key_columns(columns: DataFrame) -> DataFrame:
    """The columns of primary keys with their places (``at``) from 1."""
    place = F.row_number().over(Window.partitionBy(*TABLE).orderBy("pos"))
    return columns.where("is_pk").select("delivery", F.col("table_id").alias("parent_id"), place.alias("at"), F.col("name").alias("key_name"))


def mapped(fks: DataFrame, fk_columns: DataFrame, aliases: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Each column of a key that references one table with the column it maps to (``target``): its first alias, else the
    parent's key column of the same place.  Columns that map to nothing are left out."""
    one = resolved(fks, tables).where("matches = 1").select(*KEY, "parent", "parent_id", "parent_keys")
    alias = aliases.groupBy(*KEY, F.col("source").alias("name")).agg(F.min_by("target", "pos").alias("alias"))
    links = fk_columns.join(one, KEY).join(alias, [*KEY, "name"], "left")
    keys = key_columns(columns).withColumnRenamed("at", "pos")
    links = links.join(keys, ["delivery", "parent_id", "pos"], "left").withColumn("target", F.coalesce("alias", "key_name"))
    return links.where("target is not null").select(*KEY, "table", "parent", "parent_id", "parent_keys", "pos", "name", "target")


def fk_column(fk_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """3001: a foreign key names a column that its table does not declare."""
    return _found(fk_columns.join(columns, [*TABLE, "name"], "left_anti"), 3001, "name")


def references(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """3002, 3003: a reference resolves to no table, or to more than one."""
    rows = resolved(fks, tables)
    return _found(rows.where("matches = 0"), 3002, "parent").unionAll(_found(rows.where("matches > 1"), 3003, "parent"))


def parent_key(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """3004: the referenced table has no primary key."""
    return _found(resolved(fks, tables).where("matches = 1 and parent_keys = 0"), 3004, "parent")


def _width(fk_columns: DataFrame) -> DataFrame:
    return fk_columns.groupBy(*KEY).agg(F.count("*").alias("width"))


def arity(fks: DataFrame, fk_columns: DataFrame, tables: DataFrame) -> DataFrame:
    """3005: the key's columns are more or fewer than the parent's."""
    return _found(resolved(fks, tables).join(_width(fk_columns), KEY).where("matches = 1 and parent_keys > 0 and width <> parent_keys"), 3005, "fk")


def datatype(fks: DataFrame, fk_columns: DataFrame, aliases: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """3006: a key's column and the one it maps to are of different types.  Of columns that repeat, the first counts."""
    kinds = columns.groupBy(*TABLE, "name").agg(F.min_by("kind", "pos").alias("own_kind"))
    other = kinds.select("delivery", F.col("table_id").alias("parent_id"), F.col("name").alias("target"), F.col("own_kind").alias("parent_kind"))
    both = mapped(fks, fk_columns, aliases, columns, tables).join(kinds, [*TABLE, "name"]).join(other, ["delivery", "parent_id", "target"])
    return _found(both.where("own_kind <> parent_kind"), 3006, "name")


def alias(aliases: DataFrame, fks: DataFrame, fk_columns: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """3007: an alias of no column of the key.  3008: its target is no key column of the one table referenced.  3009: a
    target named before in the same key.  3010: of several columns some have an alias and some not."""
    names = fk_columns.select(*KEY, F.col("name").alias("source")).distinct()
    unknown = _found(aliases.join(names, [*KEY, "source"], "left_anti"), 3007, "source")
    parents = tables.where("fixed is not null").select("delivery", F.col("table_id").alias("parent_id"))
    placed = aliases.join(resolved(fks, tables).where("matches = 1").select(*KEY, "parent_id"), KEY).join(parents, ["delivery", "parent_id"])
    keys = key_columns(columns).select("delivery", "parent_id", F.col("key_name").alias("target"))
    foreign = _found(placed.join(keys, ["delivery", "parent_id", "target"], "left_anti"), 3008, "target")
    before = F.row_number().over(Window.partitionBy(*KEY, "target").orderBy("pos"))
    twice = _found(aliases.withColumn("before", before).where("before > 1"), 3009, "target")
    known = aliases.join(names, [*KEY, "source"], "left_semi").groupBy(*KEY, "table").agg(F.count_distinct("source").alias("n"))
    part = _found(known.join(_width(fk_columns), KEY).where("width > 1 and n < width"), 3010, "fk")
    return unknown.unionAll(foreign).unionAll(twice).unionAll(part)


def maps(declared: DataFrame) -> DataFrame:
    """3011: both sides of a text column's map are time masks and differ; 3012: a map on a column that is no text."""
    there = declared.where("map_from is not null")
    both = F.col("map_from").rlike(TIME_MASK) & F.col("map_to").rlike(TIME_MASK) & (F.col("map_from") != F.col("map_to"))
    return _found(there.where((F.col("kind") == TEXT) & both), 3011, "name").unionAll(_found(there.where(F.col("kind") != TEXT), 3012, "name"))


def empty_media(media: DataFrame, tables: DataFrame) -> DataFrame:
    """3013, 3014: a medium without tables, unmarked or marked as accepted."""
    empty = media.join(tables, ["delivery", "medium_id"], "left_anti")
    return _found(empty.where("not accepted"), 3013, "medium", about=False).unionAll(_found(empty.where("accepted"), 3014, "medium", about=False))


def _whole(c: Column, least: int = 0) -> Column:
    """Whether a setting is an integer of plain digits, ``least`` or more."""
    return F.coalesce(c.rlike(r"\A[0-9]+\z") & (c.try_cast("int") >= least), F.lit(False))


def spans(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """3015-3018: a span is invalid, overlaps the one before, leaves a gap, or passes the record's end."""
    rows = columns.where("span_from is not null").withColumn("a", F.col("span_from").try_cast("int")).withColumn("b", F.col("span_to").try_cast("int"))
    valid = _whole(F.col("span_from"), 1) & _whole(F.col("span_to"), 1) & F.coalesce(F.col("b") >= F.col("a"), F.lit(False))
    before = F.lag("b").over(Window.partitionBy(*TABLE).orderBy("a", "b", "pos"))
    good = rows.where(valid).withColumn("before", before)
    found = _found(rows.where(~valid), 3015, "name").unionAll(_found(good.where("a <= before"), 3016, "name")).unionAll(_found(good.where("a > before + 1"), 3017, "name"))
    lengths = tables.where(_whole(F.col("record_length"), 1)).select(*TABLE, F.col("record_length").cast("int").alias("most"))
    return found.unionAll(_found(good.join(lengths, TABLE).where("b > most"), 3018, "name"))


def scalars(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """3019: a declared setting (skipped bytes, epoch, range, record length; a column's accuracy, implied decimals
    or longest value) is no non-negative integer, or is 0 where that holds nothing.  3023: a record range does not
    start at 1 or later.  The subject is the setting, behind the column's name."""
    asked = [("SkipNumBytes", "skip_bytes", 0), ("Epoch", "epoch", 0), ("Range/To", "range_to", 0), ("Range/Length", "range_length", 0), ("Length", "record_length", 1)]
    of_column = [("Accuracy", "accuracy", 0), ("ImpliedAccuracy", "implied", 0), ("MaxLength", "max_length", 1)]

    def bad(rows: DataFrame, settings: list, subject) -> DataFrame:
        faults = [F.when(F.col(c).isNotNull() & ~_whole(F.col(c), least), subject(name)) for name, c, least in settings]
        return _found(rows.select("delivery", "table", F.explode(F.array_compact(F.array(*faults))).alias("setting")), 3019, "setting")

    found = bad(tables, asked, F.lit).unionAll(bad(columns, of_column, lambda name: F.concat(F.col("name"), F.lit(f"/{name}"))))
    return found.unionAll(_found(tables.where(F.col("range_from").isNotNull() & ~_whole(F.col("range_from"), 1)), 3023, "table"))


def symbols(tables: DataFrame) -> DataFrame:
    """3020: decimal and grouping symbol are one; 3021: the column delimiter is the record delimiter, or the
    encapsulator (each a finding of its own).  Empty symbols are none."""
    there = tables.where("column_delimiter <> ''")
    same = [_found(there.where(f"column_delimiter = {other}"), 3021, "table") for other in ("record_delimiter", "encapsulator")]
    return _found(tables.where("decimal = grouping"), 3020, "table").unionAll(same[0]).unionAll(same[1])


def date_masks(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """3022: the date mask of a column, or of the period that a table covers, is without exactly one year, month and day,
    or has stray letters or digits."""
    period = tables.where("validity_mask is not null").select("delivery", "table", F.lit("Validity").alias("name"), F.col("validity_mask").alias("mask"))
    masks = columns.where(F.col("kind") == DATE).select(*period.columns).unionAll(period)
    bare = F.regexp_replace("mask", "YYYY|YY|MM|DD", "")
    one = (F.regexp_count("mask", F.lit("YYYY|YY")) == 1) & (F.regexp_count("mask", F.lit("MM")) == 1) & (F.regexp_count("mask", F.lit("DD")) == 1)
    return _found(masks.where(~(one & ~bare.rlike("[A-Za-z0-9]"))), 3022, "name")


def identity(tables: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """3024: tables of one declared name (an error if it is referenced).  3025: tables of one location.  3026: columns of
    one name in a table."""
    names = tables.where("name is not null").groupBy("delivery", "name").agg(F.count("*").alias("n")).where("n > 1")
    wanted = fks.select("delivery", F.col("parent").alias("name"), F.lit(True).alias("wanted")).distinct()
    level = F.when(F.col("wanted"), "error").otherwise("warning")
    first = _found(names.join(wanted, ["delivery", "name"], "left"), 3024, "name", level, about=False)
    urls = tables.groupBy("delivery", "url").agg(F.count("*").alias("n")).where("n > 1")
    twice = columns.groupBy(*TABLE, "table", "name").agg(F.count("*").alias("n")).where("n > 1")
    return first.unionAll(_found(urls, 3025, "url", about=False)).unionAll(_found(twice, 3026, "name"))


def naming(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """3027: reserved characters in the name of a table or column; 3028: a description of more than 255 characters, of
    which the subject is the column, or the table."""
    both = columns.select("delivery", "table", "name", "description", F.col("name").alias("of")).unionAll(tables.select("delivery", "table", "name", "description", F.col("table").alias("of")))
    odd = _found(both.where(F.col("name").rlike(RESERVED)), 3027, "name")
    return odd.unionAll(_found(both.where(F.length("description") > LONGEST_DESCRIPTION), 3028, "of"))


def commands(declared: DataFrame) -> DataFrame:
    """3029: commands are declared; they are never run."""
    return _found(declared, 3029, "name", about=False)


# How a location begins that is not relative: a slash, a drive, a scheme.
ABSOLUTE = r"\A(?:/|\\|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]+:)"


def normal_path(path: Column) -> Column:
    """A relative location without ``.`` and ``..``; null if it leads out of its root, or to it."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("out"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        left = F.when(up, F.slice(state.path, 1, F.greatest(F.size(state.path) - 1, F.lit(0)))).otherwise(F.array_append(state.path, part))
        return F.struct(left.alias("path"), (state.out | (up & (F.size(state.path) == 0))).alias("out"))

    done = F.aggregate(parts, start, step)
    return F.when(~done.out & (F.size(done.path) > 0), F.array_join(done.path, "/"))


def entry_name(name: Column) -> Column:
    """An entry's name in the form that locations have."""
    return F.ltrim(F.translate(name, "\\", "/"), F.lit("/"))


def extensions(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """3030: an extension is declared; 3031: the file it names is absent, or no location within the delivery."""
    path = F.when(~F.col("url").rlike(ABSOLUTE), normal_path(F.col("url")))
    there = entries.select("delivery", entry_name(F.col("name")).alias("path")).distinct()
    lost = declared.withColumn("path", path).join(there, ["delivery", "path"], "left_anti")
    return _found(declared, 3030, "name", about=False).unionAll(_found(lost, 3031, "name", about=False))


def file_presence(tables: DataFrame, entries: DataFrame) -> DataFrame:
    """1003-1006: a declared file is absent, given absolutely, leads out of the root, or is there in
    other letter case only."""
    rows = tables.withColumn("absolute", F.col("url").rlike(ABSOLUTE)).withColumn("path", normal_path(F.col("url")))
    inside = rows.where(~F.col("absolute") & F.col("path").isNotNull())
    files = entries.select("delivery", entry_name(F.col("name")).alias("path")).distinct()
    missing = inside.join(files, ["delivery", "path"], "left_anti").withColumn("low", F.lower("path"))
    lowered = files.select("delivery", F.lower("path").alias("low")).distinct()
    return (
        _found(missing.join(lowered, ["delivery", "low"], "left_anti"), 1003, "url")
        .unionAll(_found(rows.where("absolute"), 1004, "url"))
        .unionAll(_found(rows.where("not absolute and path is null"), 1005, "url"))
        .unionAll(_found(missing.join(lowered, ["delivery", "low"], "left_semi"), 1006, "url"))
    )


def entry_collision(entries: DataFrame) -> DataFrame:
    """1007: two entries have one normal name."""
    same = entries.groupBy("delivery", entry_name(F.col("name")).alias("path")).agg(F.count("*").alias("n")).where("n > 1")
    return _found(same, 1007, "path", about=False)


def index_presence(entries: DataFrame, index: str = "index.xml") -> DataFrame:
    """1001, 1002: the description is missing, or lies deeper in the tree only."""
    at, deeper = F.count_if(F.col("name") == index), F.count_if(F.col("name").endswith("/" + index))
    rows = entries.groupBy("delivery").agg(at.alias("at"), deeper.alias("deeper")).withColumn("name", F.lit(index))
    return _found(rows.where("at = 0 and deeper = 0"), 1001, "name", about=False).unionAll(_found(rows.where("at = 0 and deeper > 0"), 1002, "name", about=False))


def relationships(tables: DataFrame, fks: DataFrame) -> DataFrame:
    """For each table what its keys reference, and the tables whose keys reference it and no other."""
    out = fks.groupBy(*TABLE).agg(F.array_join(F.sort_array(F.collect_set("parent")), ",").alias("refers_to"))
    inbound = resolved(fks, tables).where("matches = 1")
    back = inbound.groupBy("delivery", F.col("parent_id").alias("table_id")).agg(F.array_join(F.sort_array(F.collect_set("table")), ",").alias("referred_by"))
    names = tables.select(*TABLE, "table")
    return names.join(out, TABLE, "left").join(back, TABLE, "left").fillna("", ["refers_to", "referred_by"])


def tree(tables: DataFrame) -> DataFrame:
    """Media with their tables in declared order."""
    return tables.groupBy("delivery", "medium_id", "medium").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_id", "table"))), lambda t: t.table), ",").alias("tables"))
