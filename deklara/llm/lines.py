"""Operator 8: near-duplicate lines across documents.

A line is what stands between line feeds; its normal form is its letters and digits in lower case,
the digits 1-9 as 0, other characters as one blank.  Lines without a letter or digit have no normal form and
are never touched.  Lines of one normal form are one class.  Classes that agree in a block of their SimHash
(``lineblocks``) are candidates and are linked if the edit distance of their normal forms is at most
``1 - similarity`` of the longer one's length.  Of each connected group the occurrence with the smallest
(doc_id, line number) stays and all others go.

Lines are known by a 64-bit hash of the normal form while they are grouped; texts are fetched only of
the candidates.

Defined results: null texts have no lines and stay null.  Texts that lose every line become empty, and
their documents stay.  Rows that repeat a doc_id are one document: what is at the same line number in several of
them is kept in all of them or in none.  A null doc_id is smaller than any other, and rows without an id are
taken likewise.  No line goes but for one of its group that stays.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deklara.llm import edits, lineblocks, linkage
from deklara.llm.common import materialise, remove, row_of, row_schema

#: Line hashes that a task remembers at most.
MEMORY = 500_000
#: Times that lines between groups are held against a few others before all that are left are paired.
TURNS = 2
LINES = "doc_id bigint, line int, node bigint, keys array<bigint>"


def _lines(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines with a normal form; a task gives the keys of a form once, if memory allows."""
    done: set[int] = set()
    for batch in batches:
        for parts, rows, before in lineblocks.chunks(batch.column(1).to_pylist()):
            lines, starts = lineblocks.read(parts)
            part = np.searchsorted(starts, lines.number, "right") - 1
            nodes, firsts = np.unique(lines.node, return_index=True)
            fresh = np.sort([i for node, i in zip(nodes.tolist(), firsts.tolist(), strict=True) if node not in done]).astype(np.int64)
            if len(done) >= MEMORY:
                done.clear()
            done.update(nodes.tolist())
            owner, keys = lineblocks.band_keys(lines, fresh, similarity)
            counts = np.zeros(len(lines.node) + 1, np.int32)
            counts[1:] = np.bincount(fresh[owner], minlength=len(lines.node))
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(keys[np.argsort(owner, kind="stable")].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.array(rows, np.int64)[part])),
                    pa.array((lines.number - starts[part] + np.array(before, np.int64)[part]).astype(np.int32)),
                    pa.array(lines.node.view(np.int64)),
                    listed,
                ],
                names=["doc_id", "line", "node", "keys"],
            )


def _chosen(texts: list[str | None], numbers: list[list[int]]) -> Iterator[tuple[lineblocks.Lines, np.ndarray, np.ndarray, list[list[str]]]]:
    """Of each text the lines of these numbers, if they have a normal form: text and place in its list of each line, and the
    lines of the whole list.  No other line is hashed."""
    chosen = []
    for text, wanted in zip(texts, numbers, strict=True):
        found = (text or "").split("\n") if wanted else []
        chosen.append([found[n] if n < len(found) else "" for n in wanted])
    for parts, rows, before in lineblocks.chunks(["\n".join(c) for c in chosen]):
        lines, starts = lineblocks.read(parts)
        part = np.searchsorted(starts, lines.number, "right") - 1
        yield lines, np.array(rows, np.int64)[part], lines.number - starts[part] + np.array(before, np.int64)[part], chosen


def _wanted_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal forms of the wanted lines of a document, their lengths, and the counts of their characters."""
    for batch in batches:
        wanted = batch.column("wanted").to_pylist()
        for lines, row, place, chosen in _chosen(batch.column("text").to_pylist(), [[w["line"] for w in some] for some in wanted]):
            nodes = lines.node.view(np.int64).tolist()
            found = [i for i, (r, n) in enumerate(zip(row.tolist(), place.tolist(), strict=True)) if wanted[r][n]["node"] == nodes[i]]
            texts = [" ".join(lineblocks.forms(chosen[row[i]][place[i]])[0]) for i in found]
            counts = [edits.counts_of(edits.codes_of(t), edits.FEW_BINS) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines.node[found].view(np.int64)), pa.array(texts, pa.string()), pa.array(lines.chars[found].astype(np.int32)), pa.array(counts, pa.list_(pa.int32()))],
                names=["node", "form", "size", "counts"],
            )


def _near(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs within the edit distance."""
    for batch in batches:
        codes: dict[str, np.ndarray] = {}
        pairs = []
        for one, two in zip(batch.column("form_a").to_pylist(), batch.column("form_b").to_pylist(), strict=True):
            for form in (one, two):
                if form not in codes:
                    codes[form] = edits.codes_of(form)
            pairs.append((codes[one], codes[two]))
        keep = edits.all_within(pairs, [int(max(len(a), len(b)) * (1 - similarity) + 1e-9) for a, b in pairs])
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def near_lengths(similarity: float, size: Column, other: Column) -> Column:
    """Lengths that are no further apart than the edits allowed."""
    return (size >= other * similarity - 1e-6) & (other >= size * similarity - 1e-6)


def near_counts(similarity: float, size: Column, counts: Column, other_size: Column, other: Column) -> Column:
    """Counts of characters that are no further apart than the edits allowed, each of which takes one character
    away and gives one at most."""
    more = F.aggregate(F.zip_with(counts, other, lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda total, n: total + n)
    return more + F.greatest(other_size - size, F.lit(0)) <= F.floor(F.greatest(size, other_size) * (1 - similarity) + 1e-9)


def removed_lines(docs: DataFrame, similarity: float = 0.9) -> DataFrame:
    """(doc_id, removed): the lines that go, as (line number, node), of each document that loses any."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lines, lines_path = materialise(docs.mapInArrow(partial(_lines, similarity), LINES), "lines")
    classes = lines.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first"))
    classes, classes_path = materialise(classes, "line-classes")
    # Most keys are those of one class: they go before classes are put together, as tasks may repeat a class.
    every = lines.select("node", F.explode("keys").alias("key"))
    several = every.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    keys, keys_path = materialise(every.join(several.hint("shuffle_hash"), "key", "left_semi").distinct(), "line-keys")
    paths = [lines_path, classes_path, keys_path]

    def rule_for(candidates: DataFrame) -> linkage.Rule:
        own, own_path = materialise(classes.join(candidates, "node", "left_semi").select("node", "first.*"), "candidate-lines")
        wanted = own.groupBy("doc_id").agg(F.collect_list(F.struct("line", "node")).alias("wanted"))
        texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("text", "wanted")
        forms, forms_path = materialise(texts.mapInArrow(_wanted_forms, "node bigint, form string, size int, counts array<int>").dropDuplicates(["node"]), "forms")
        paths.extend([own_path, forms_path])

        def verify(pairs: DataFrame) -> DataFrame:
            def side(s: str) -> DataFrame:
                return forms.select(F.col("node").alias(s), F.col("form").alias(f"form_{s}"))

            both = pairs.join(side("a"), "a").join(side("b"), "b")
            return both.select("a", "b", "form_a", "form_b").mapInArrow(partial(_near, similarity), "a bigint, b bigint")

        def rest(rows: DataFrame, large: bool) -> DataFrame:
            """Every pair that shares a small key, or large keys alone, lies in two groups, and has near lengths and counts of characters."""
            # Of the keys that two lines share the smallest yields the pair.
            sets = [F.collect_set(F.when(F.col("large") == kind, F.col("key"))).alias(name) for name, kind in (("few", False), ("many", True))]
            own_keys = rows.groupBy("node").agg(*sets)
            sized = rows.where(F.col("large") == large).join(forms.select("node", "size", "counts").join(own_keys, "node"), "node")
            other = sized.select("key", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "main", "size", "counts", "few", "many")))
            few, many = F.array_intersect("few", "other_few"), F.array_intersect("many", "other_many")
            once = (F.size(few) == 0) & (F.array_min(many) == F.col("key")) if large else F.array_min(few) == F.col("key")
            apart = (F.col("component") != F.col("other_component")) & (F.col("other_main") | (F.col("node") < F.col("other_node")))
            near = near_counts(similarity, F.col("size"), F.col("counts"), F.col("other_size"), F.col("other_counts"))
            pairs = sized.where("not main").join(other, "key").where(apart & near_lengths(similarity, F.col("size"), F.col("other_size")) & near & once)
            return pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b"))

        return linkage.Rule(verify, rest, turns=TURNS)

    members = linkage.groups(keys, rule_for)
    placed = (
        classes.select("node", "n", "first")
        .join(members, "node", "left")
        .where("n > 1 or component is not null")
        .select("node", "first", F.coalesce("component", "node").alias("component"))
    )
    placed, placed_path = materialise(placed, "placed-lines")
    kept, kept_path = materialise(placed.groupBy("component").agg(F.min("first").alias("kept")), "kept-lines")
    staying, staying_path = materialise(placed.join(kept, "component").select("node", "kept"), "staying-lines")
    gone = (
        lines.select("doc_id", "line", "node")
        .join(staying, "node")
        .where(~F.struct("doc_id", "line").eqNullSafe(F.col("kept")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("line", "node")).alias("removed"))
    )
    gone, _ = materialise(gone, "removed-lines")
    remove(spark, *paths, placed_path, kept_path, staying_path)
    return gone


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("row").field("text").to_pylist()
        gone = [some or [] for some in batch.column("removed").to_pylist()]
        drop = [set() for _ in texts]
        # Rows that repeat an id may have other lines there.
        for lines, row, place, _ in _chosen(texts, [[r["line"] for r in some] for some in gone]):
            for i, n, node in zip(row.tolist(), place.tolist(), lines.node.view(np.int64).tolist(), strict=True):
                if gone[i][n]["node"] == node:
                    drop[i].add(gone[i][n]["line"])
        clean = [text if not out else "\n".join(line for n, line in enumerate(text.split("\n")) if n not in out) for text, out in zip(texts, drop, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(clean, pa.string()), pa.array([lineblocks.count(t) for t in texts], pa.int64()), pa.array([len(out) for out in drop], pa.int64())],
            names=["row", "clean", "n_lines", "n_removed"],
        )


def deduplicated(docs: DataFrame, similarity: float = 0.9, counts: bool = True) -> DataFrame:
    """``docs`` with the texts that remain.  With ``counts`` it also has n_lines and n_removed, in the
    place of columns of these names if there are any."""
    gone = removed_lines(docs, similarity).withColumnRenamed("doc_id", "gone_from")
    both = docs.select(F.col("doc_id").cast("bigint").alias("at"), row_of(docs))
    both = both.join(gone, both["at"].eqNullSafe(gone["gone_from"]), "left").select("row", "removed")
    clean = both.mapInArrow(_without, row_schema(docs, clean="string", n_lines="bigint", n_removed="bigint"))
    more = ["n_lines", "n_removed"] if counts else []
    own = [F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in more]
    return clean.select(*own, *more)
