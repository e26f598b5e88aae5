"""Rollups: rows without a language, and commits that a lost driver left empty."""

import pytest

from deklara.llm import queries, rollups


def test_rows_without_a_language_are_counted_anew(spark, tmp_path):
    docs = [(1, "don't stop", "en", "w"), (2, "l'eau, ici", None, "w"), (3, "gut so!", "de", "w"), (4, "weg", None, "w")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.op6_token_rollups(spark, str(tmp_path)).collect()
    expected = {("w", "en", "words-1", 1, 2), ("w", None, "letters-2", 1, 5), ("w", "de", "letters-2", 1, 3)}
    assert {(r["source"], r["lang"], r["tokenizer"], r["documents"], r["tokens"]) for r in found} == expected


def test_an_empty_commit_is_none(spark, tmp_path):
    (tmp_path / "commits").mkdir()
    (tmp_path / "commits" / "b").touch()
    rollup = rollups.Rollup(spark, str(tmp_path))
    rows = spark.createDataFrame([("w", "en", "words-1", 3, 1)], "source string, lang string, tokenizer string, tokens bigint, sign int")
    assert rollup.add("b", rows) and not rollup.add("b", rows) and rollup.batches() == ["b"]
    assert [r["tokens"] for r in rollup.totals().collect()] == [3]
    assert rollup._commit("c", "sums/x") and not rollup._commit("c", "sums/y") and rollup._commits()["c"] == "sums/x"


def test_a_batch_added_during_compaction_counts_once(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("w", "en", "words-1", n, 1)], "source string, lang string, tokenizer string, tokens bigint, sign int")
    rollup = rollups.Rollup(spark, str(tmp_path))
    assert rollup.add("first", rows(5))
    listing, late = rollup._commits, []

    def commits():
        found = listing()
        if not late:
            late.append(rollup.add("second", rows(7)))
        return found

    rollup._commits = commits
    rollup.compact()
    assert late == [True] and [r["tokens"] for r in rollup.totals().collect()] == [12]
    with pytest.raises(ValueError):
        rollup.add("base-x", rows(1))
