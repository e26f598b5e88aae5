"""Scratch tables in the shared folder, and numbering that no single task has to do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows up to which a small table (one row for each split, file or partition) is sent to every task.
SMALL = 1_000_000
_ROWS = (1 << 33) - 1  # the place within a partition, in ``monotonically_increasing_id``
_scopes: list[list[str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.  A session on one machine that names none gets
    a temporary one; on a cluster, where executors could not reach that, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="deklara-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it goes with the innermost ``scope``, if one is open."""
    path = f"{checkpoint_root(spark)}/deklara/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables written within go at its end: what is to be kept is written or collected before."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        remove(spark, *own)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def all_written(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """Small tables written side by side: each is a job of little more than its start."""
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(tables, pool.map(lambda n: written(tables[n], f"{name}-{n}"), tables), strict=True))


def stored_in_order(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` as a written table whose files hold ranges of one column, in its order."""
    return written(df.repartitionByRange(by).sortWithinPartitions(by), name)


def with_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a written table of few rows: these go to every task if they are ``SMALL`` or less, else the join is
    left to the optimizer."""
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, on, how)


class Sorted:
    """A table stored in a total order, one file for each range of it, with an index of the files' first positions.

    ``rows`` has the position ``name`` of every row.  ``page`` opens only the files that the index names, and of
    them only row groups that hold the places asked for.  ``index`` is a table of one row for each file: its range, its
    name, how many rows it has, and the position of the range's first row."""

    def __init__(self, df: DataFrame, order: list[Column], name: str = "pos", first: int = 0):
        self._spark, self._name, self._columns = df.sparkSession, name, df.columns
        path = scratch(self._spark, "sorted")
        placed = df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS)))
        placed.write.parquet(path)
        self._schema = placed.schema
        self._stored = self._spark.read.schema(self._schema).parquet(path)
        files = self._stored.groupBy("_part", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
        before = Window.orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)  # one row for each file
        starts = F.coalesce(F.sum("n").over(before), F.lit(0)) + first
        self.index = written(files.select("_part", "file", "n", starts.alias("_first")), "sorted-index")

    def _numbered(self, rows: DataFrame, starts: DataFrame) -> DataFrame:
        cells = (F.col("`" + c.replace("`", "``") + "`") for c in self._columns)
        return with_small(rows, starts, ["_part"]).select(*cells, (F.col("_first") + F.col("_at")).alias(self._name))

    @property
    def rows(self) -> DataFrame:
        return self._numbered(self._stored, self.index.select("_part", "_first").distinct())

    def page(self, first: int, count: int) -> DataFrame:
        """Rows ``first`` to ``first + count - 1``."""
        total, last = F.sum("n").over(Window.partitionBy("_part")), first + count - 1
        touched = self.index.withColumn("n", total).where((F.col("_first") <= last) & (F.col("_first") + F.col("n") > first))
        found = touched.select("_part", "file", "_first").collect()  # the files that a page lies in
        if not found:
            return self.rows.limit(0)
        low = first - found[0]["_first"] if len({r["_part"] for r in found}) == 1 else 0
        rows = self._spark.read.schema(self._schema).parquet(*(r["file"] for r in found))
        rows = rows.where(F.col("_at").between(low, max(last - r["_first"] for r in found)))
        starts = self._spark.createDataFrame(sorted({(r["_part"], r["_first"]) for r in found}), "_part int, _first bigint")
        return self._numbered(rows, starts).where(F.col(self._name).between(first, last))


def numbered(df: DataFrame, order: list[Column], name: str = "pos", first: int = 0) -> DataFrame:
    """``df`` in a total order with positions ``first``, ``first + 1``, ...

    The sort range-partitions; each partition's rows are numbered where they are, and the numbers of
    the partitions' first rows are sums of the counts before: a table of one row for each partition, which is joined.
    """
    return Sorted(df, order, name, first).rows
