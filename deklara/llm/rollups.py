"""Operator 6: token counts as delta-maintained rollups.

A rollup holds additive totals (documents, tokens) by source, language and tokenizer version.  It is
never computed again: batches of signed rows are added to it.  An insert counts +1, a delete -1, and
a revised count is a delete of the old row and an insert of the new one.

A batch is one directory of partial sums.  It counts once its commit file exists, and that file is
created only if it does not exist yet and names the attempt whose data it stands for.  So a batch that
is sent again, by a retry or by two drivers at once, adds nothing; an attempt that died before its
commit leaves files that no reader looks at.  Reading sums the committed batches;  ``compact`` folds
them into one base, again by one commit.

What is grouped are partial sums by key, at most one row for each key, task and batch, so a source
that holds a third of all rows costs no more than another.

Defined results: a null source or language is a group of its own; a null count is 0 tokens of a
document that does count; rows with a null sign count as inserts; a group whose documents have all
been deleted is left out.  An empty batch commits and adds nothing.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SUMS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"

#: Tokenizer versions that are plain column functions: a text's number of tokens.
COUNTERS = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "letters-2": lambda text: F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]")),
}


def tokens(text: Column, version: str) -> Column:
    """A text's number of tokens; 0 for a null text."""
    return F.coalesce(COUNTERS[version](text), F.lit(0)).cast("bigint")


def signed(counts: DataFrame, version: str, sign: int = 1) -> DataFrame:
    """Signed rows (source, lang, tokenizer, tokens, sign) from a table with one column of counts
    for each tokenizer version, named like it."""
    return counts.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(f"`{version}`").alias("tokens"), F.lit(sign).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that replace the counted rows ``old`` by ``new``."""
    return old.withColumn("sign", -F.col("sign")).unionByName(new)


def summed(rows: DataFrame) -> DataFrame:
    sign: Column = F.coalesce("sign", F.lit(1)).cast("bigint")
    return rows.groupBy(*KEYS).agg(
        F.sum(sign).alias("documents"), F.sum(sign * F.coalesce(F.col("tokens").cast("bigint"), F.lit(0))).alias("tokens")
    )


class Rollup:
    """A rollup below ``root``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self._root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commit(self, name: str, content: str) -> bool:
        """Create a commit file, which only one of several writers can; False if there is one.  It is written
        elsewhere and renamed, so a writer that dies leaves no commit; an empty one counts as none."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", name):
            raise ValueError(f"not a batch name: {name!r}")
        if self._committed(name):
            return False
        draft, target = self._path(f"{self._root}/drafts/{name}-{uuid.uuid4().hex}"), self._path(f"{self._root}/commits/{name}")
        out = self._files.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        self._files.mkdirs(target.getParent())
        hadoop, gateway = self._spark._jvm.org.apache.hadoop.fs, self._spark.sparkContext._gateway
        rename = getattr(hadoop, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if self._files.exists(target) else rename.NONE
        try:
            hadoop.FileContext.getFileContext(self._files.getUri(), self._spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                self._files.delete(draft, False)
                return False
            raise
        return True

    def _committed(self, name: str) -> bool:
        path = self._path(f"{self._root}/commits/{name}")
        return self._files.exists(path) and self._files.getFileStatus(path).getLen() > 0

    def _commits(self) -> dict[str, str]:
        path = self._path(f"{self._root}/commits")
        if not self._files.exists(path):
            return {}
        rows = self._spark.read.text(f"{self._root}/commits", wholetext=True).select(
            F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value"
        )
        return {r["name"]: r["value"].strip() for r in rows.where("value <> ''").collect()}

    def add(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch of signed rows once; False if a batch of this name was committed before."""
        if batch.startswith("base-"):
            raise ValueError(f"names of this kind are those of compactions: {batch!r}")
        if self._committed(batch):
            return False
        attempt = f"sums/{batch}-{uuid.uuid4().hex}"
        summed(rows).write.parquet(f"{self._root}/{attempt}")
        return self._commit(batch, attempt)

    def batches(self) -> list[str]:
        return sorted(b for b in self._commits() if not b.startswith("base-"))

    def totals(self) -> DataFrame:
        return self._totals(self._commits())

    def _totals(self, commits: dict[str, str]) -> DataFrame:
        bases = sorted((b for b in commits if b.startswith("base-")), key=lambda b: int(b[5:]))
        folded: set[str] = set()
        parts = []
        if bases:
            attempt, *names = commits[bases[-1]].split("\n")
            parts, folded = [attempt], set(names)
        parts += [p for b, p in sorted(commits.items()) if not b.startswith("base-") and b not in folded]
        if not parts:
            return self._spark.createDataFrame([], SUMS)
        sums = self._spark.read.schema(SUMS).parquet(*(f"{self._root}/{p}" for p in parts))
        return (
            sums.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0")
        )

    def compact(self) -> None:
        """Fold all committed batches into one base.  Batch names stay known, so none counts again.
        What is added meanwhile is in neither the base's names nor its sums: both come from one listing."""
        commits = self._commits()
        names = sorted(b for b in commits if not b.startswith("base-"))
        number = 1 + max((int(b[5:]) for b in commits if b.startswith("base-")), default=-1)
        attempt = f"sums/base-{uuid.uuid4().hex}"
        self._totals(commits).write.parquet(f"{self._root}/{attempt}")
        self._commit(f"base-{number}", "\n".join([attempt, *names]))
