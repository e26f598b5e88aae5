"""Primary and foreign keys over stored tables: gaps, duplicates, references, and following them.

A parent's key with an empty part is no key.  A child's key whose parts are all empty is an absent
reference; one that is partly empty is looked up, and not found.  Keys are compared column by column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deklara.operators import lint
from deklara.tables import numbered, written


def _all(columns: list[Column]) -> Column:
    return reduce(Column.__and__, columns)


def quoted(columns: list[str]) -> Column:
    """A key as findings show it."""
    return F.concat_ws("|", *(F.col(c) for c in columns))


def incomplete(table: DataFrame, key: list[str]) -> DataFrame:
    """Records of a table whose key has an empty part."""
    return table.where(reduce(Column.__or__, (F.col(c) == "" for c in key)))


def duplicates(table: DataFrame, key: list[str], ordinal: str = "_ordinal", most: int = 10_000) -> DataFrame:
    """Complete keys that more than one record carries: key, n, first record, all records in order.  A key of
    more than ``most`` records has a row for each list of ``most``.

    The keys are counted first, and only the records of repeated keys are gathered into lists.  The places of records
    within keys of over ``most`` come from a range-partitioned numbering, so no task holds all records of a key."""
    whole = table.where(_all([F.col(c) != "" for c in key]))
    repeated = written(whole.groupBy(*key).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).where("n > 1"), "repeated-keys")
    rows = whole.select(*key, F.col(ordinal).alias("_record")).join(repeated, key)
    return listed(rows, repeated, key, most).select(quoted(key).alias("key"), "n", "first", "records")


def first_duplicates(table: DataFrame, key: list[str], bound: int, ordinal: str = "_ordinal", most: int = 10_000) -> DataFrame:
    """Of the keys that more than one record carries the ``bound`` whose first records come first (of keys of one
    first record, the smaller), with their place: place, key, n, first, records.

    Only the records of these keys are gathered, whatever the number of repeated keys."""
    whole = table.where(_all([F.col(c) != "" for c in key]))
    repeated = whole.groupBy(*key).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).where("n > 1")
    some = repeated.orderBy("first", *key).limit(bound)
    some = written(some.withColumn("place", F.row_number().over(Window.orderBy("first", *key))), "first-repeated-keys")  # ``bound`` rows
    rows = whole.select(*key, F.col(ordinal).alias("_record")).join(some.drop("place"), key)
    return listed(rows, some, key, most).join(some.select(*key, "place"), key).select("place", quoted(key).alias("key"), "n", "first", "records")


def listed(rows: DataFrame, repeated: DataFrame, key: list[str], most: int = 10_000) -> DataFrame:
    """``rows`` (key columns, _record, n, first) as lists of the keys' records: key columns, n, first, records."""
    told = F.array_join(F.sort_array(F.collect_list("_record")).cast("array<string>"), ", ").alias("records")
    cells = [F.max("n").alias("n"), F.max("first").alias("first"), told]
    found = rows.where(F.col("n") <= most).groupBy(*key).agg(*cells)
    if repeated.where(F.col("n") > most).isEmpty():
        return found
    large = numbered(rows.where(F.col("n") > most), [*(F.col(c) for c in key), F.col("_record")], "_pos")
    starts = large.groupBy(*key).agg(F.min("_pos").alias("_start"))
    place = F.floor((F.col("_pos") - F.col("_start")) / most).alias("_list")
    return found.unionByName(large.join(starts, key).groupBy(*key, place).agg(*cells).drop("_list"))


# The keys of many tables at once


def links(c: dict[str, DataFrame]) -> DataFrame:
    """What of each table is a key: (delivery, table_id, fk, target_id, target, positions).  ``fk`` -1 is its own primary
    key; the others are its foreign keys that map onto the whole key of one table, with the positions of
    their columns in the order of that key.  Of columns that repeat, the first counts; of two that map to one
    key column, the last."""
    keys = lint.key_columns(c["columns"])
    of_key = c["columns"].where("is_pk").groupBy(*lint.TABLE).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    own = c["tables"].join(of_key, lint.TABLE).select(*lint.TABLE, F.lit(-1).alias("fk"), F.col("table_id").alias("target_id"), F.col("table").alias("target"), "positions")
    mapped = lint.mapped(c["fks"], c["fk_columns"], c["aliases"], c["columns"], c["tables"])
    last = mapped.groupBy(*lint.KEY, "parent", "parent_id", "parent_keys", F.col("target").alias("key_name")).agg(F.max_by("name", "pos").alias("name"))
    first = c["columns"].groupBy(*lint.TABLE, "name").agg(F.min("pos").alias("pos"))
    placed = last.join(keys, ["delivery", "parent_id", "key_name"]).join(first, [*lint.TABLE, "name"])
    whole = placed.groupBy(*lint.KEY, "parent", "parent_id", "parent_keys").agg(F.sort_array(F.collect_list(F.struct("at", "pos"))).alias("p"))
    foreign = whole.where(F.size("p") == F.col("parent_keys")).select(*lint.KEY, F.col("parent_id").alias("target_id"), F.col("parent").alias("target"), F.col("p.pos").alias("positions"))
    return own.unionByName(foreign)


def key_values(records: DataFrame, links: DataFrame, columns: int) -> DataFrame:
    """The values of all keys of scanned records (delivery, table_id, table, _ordinal, c0..), one row for each record and key:
    (delivery, target_id, key, fk, table, target, _ordinal).  References whose parts are all empty are none."""
    cells = F.array(*(F.col(f"c{i}") for i in range(columns))) if columns else F.array().cast("array<string>")
    asked = links.groupBy(*lint.TABLE).agg(F.collect_list(F.struct("fk", "target_id", "target", "positions")).alias("links"))
    rows = records.select(*lint.TABLE, "table", "_ordinal", cells.alias("cells")).join(asked, lint.TABLE)
    rows = rows.select("delivery", "table", "_ordinal", "cells", F.explode("links").alias("k"))
    # As many cells as the widest key has: functions of arrays that take lambdas are not compiled.
    width = links.agg(F.max(F.size("positions"))).first()[0] or 0
    key = F.slice(F.array(*(F.get("cells", F.get("k.positions", F.lit(i))) for i in range(width))), F.lit(1), F.size("k.positions")) if width else F.array().cast("array<string>")
    rows = rows.select("delivery", F.col("k.target_id").alias("target_id"), key.alias("key"), F.col("k.fk").alias("fk"), "table", F.col("k.target").alias("target"), "_ordinal")
    return rows.where((F.col("fk") == -1) | (F.array_join("key", "") != ""))


def parent_keys(parent: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """The distinct complete keys of a parent under the child's column names."""
    return parent.where(_all([F.col(c) != "" for c in key])).select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True))).distinct()


def unresolved(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    """Child records whose reference is there and names no parent record: an anti join."""
    referring = child.where(~_all([F.col(c) == "" for c in columns]))
    return referring.join(parent_keys(parent, key, columns), columns, "left_anti")


def unchecked(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """References (delivery, table_id, table, fk, parent) that cannot be compared: the parent is one table with a primary
    key, but could not be read.  ``tables`` are (delivery, table_id, table, pk_count, ready)."""
    shut = tables.where("not ready").select("delivery", F.col("table_id").alias("parent_id"))
    one = lint.resolved(fks, tables).where("matches = 1 and parent_keys > 0").join(shut, ["delivery", "parent_id"], "left_semi")
    return one.select(*fks.columns)


def unresolved_between(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str], first: int, last: int) -> DataFrame:
    return unresolved(child.where(F.col("_ordinal").between(first, last)), columns, parent, key)


def unresolved_among(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str], ordinals: DataFrame) -> DataFrame:
    return unresolved(child.join(ordinals.select("_ordinal"), "_ordinal", "left_semi"), columns, parent, key)


def follow(child: DataFrame, columns: list[str], parent: DataFrame, key: list[str]) -> DataFrame:
    """Each child record with the first parent record of its key: (_ordinal, target, matches, kind)."""
    targets = parent.where(_all([F.col(c) != "" for c in key])).groupBy(*key).agg(F.min("_ordinal").alias("target"), F.count("*").alias("found"))
    targets = targets.select(*(F.col(k).alias(c) for c, k in zip(columns, key, strict=True)), "target", "found")
    absent = _all([F.col(c) == "" for c in columns])
    kind = F.when(absent, "no reference").when(F.col("target").isNull(), "unresolved").otherwise("positioned")
    return child.join(targets, columns, "left").select("_ordinal", "target", F.coalesce("found", F.lit(0)).alias("matches"), kind.alias("kind"))


def follow_back(parent: DataFrame, key: list[str], child: DataFrame, columns: list[str], nth: int = 1) -> DataFrame:
    """Each parent record with the number of records that refer to it and the nth of them in file
    order, the last if there are fewer."""
    referring = child.where(~_all([F.col(c) == "" for c in columns])).select(*(F.col(c).alias(k) for c, k in zip(columns, key, strict=True)), "_ordinal")
    counts = referring.groupBy(*key).agg(F.count("*").alias("matches"), F.min("_ordinal").alias("lowest"))
    if nth == 1:
        counts = counts.select(*key, "matches", F.col("lowest").alias("target"))
    else:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("_ordinal"))
        at = referring.withColumn("place", place).where(F.col("place") <= nth).groupBy(*key).agg(F.max_by("_ordinal", "place").alias("target"))
        counts = counts.join(at, key).select(*key, "matches", "target")
    return parent.join(counts, key, "left").select("_ordinal", F.coalesce("matches", F.lit(0)).alias("matches"), "target")


def count_matching(table: DataFrame, columns: list[str], wanted: DataFrame) -> DataFrame:
    """How many records of a table carry each of the wanted keys."""
    counts = table.join(wanted.select(*columns).distinct(), columns, "left_semi").groupBy(*columns).agg(F.count("*").alias("n"))
    return wanted.select(*columns).distinct().join(counts, columns, "left").select(*columns, F.coalesce("n", F.lit(0)).alias("n"))


def marks(child: DataFrame, references: list[tuple[list[str], DataFrame, list[str]]]) -> DataFrame:
    """Per record the columns that belong to an unresolved reference, over all references."""
    parts = [unresolved(child, c, p, k).select("_ordinal", F.array(*map(F.lit, c)).alias("columns")) for c, p, k in references]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("_ordinal").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("columns")))), ",").alias("columns"))
