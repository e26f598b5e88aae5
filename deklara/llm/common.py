"""What the corpus operators share: the scratch folder, tables, and small column helpers.

Everything that must survive the loss of an executor is written below the folder that the
cluster names in ``spark.checkpoint.dir``.  Nothing uses a machine-local folder unless that
setting is absent, as in unit tests on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "bigint": LongType()}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one of this machine only if the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = tempfile.mkdtemp(prefix="deklara-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/deklara/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there, and the shuffle
    files of the write go with its end, as nothing can ask for them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that none can clash with an operator's own."""
    return F.struct(*(column(c) for c in df.columns)).alias("row")


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column, or that of its ``row``, so that no text has to be sent twice."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def row_schema(df: DataFrame, **more: str) -> StructType:
    """The schema of ``row`` and further columns, given by their types."""
    return StructType([StructField("row", df.schema), *(StructField(n, _KINDS[t]) for n, t in more.items())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def hash_share(column: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the value alone: the basis of repeatable samples."""
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1 << 40)) / F.lit(float(1 << 40))
