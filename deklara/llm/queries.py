"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deklara.llm import (
    additive_quality, alignment, binary_packing, boosted_rules, languages, lines, media, minhash, packing, pieces, rollups, toxicity, whitening,
)
from deklara.llm.common import materialise, scratch_path, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return boosted_rules.judge(docs, boosted_rules.fit(docs, table(spark, sf_dir, "labels")))


def op3_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "media")
    media.store(table(spark, sf_dir, "documents"), root)
    return media.digests(spark, root)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages.identify(docs, *languages.fit(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: all are counted; those that a review marked as of low quality
    are deleted; the rest of all but the English ones is counted anew by a later tokenizer version.
    Two batches are sent twice, and the rollup is compacted between."""
    docs = table(spark, sf_dir, "documents")
    both = docs.select("doc_id", "source", "lang", *(rollups.tokens(docs["text"], v).alias(v) for v in rollups.COUNTERS))
    both, _ = materialise(both, "token-counts")
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    first = rollups.signed(both, "words-1")
    deleted = rollups.signed(both.join(low, "doc_id", "left_semi"), "words-1", -1)
    rest = both.join(low, "doc_id", "left_anti").where("not (lang <=> 'en')")
    revised = rollups.revised(rollups.signed(rest, "words-1"), rollups.signed(rest, "letters-2"))
    rollup = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    for name, rows in (("count-1", first), ("review-1", deleted), ("review-1", deleted)):
        rollup.add(name, rows)
    rollup.compact()
    for name, rows in (("count-1", first), ("recount-1", revised)):
        rollup.add(name, rows)
    return rollup.totals()


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.deduplicated(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "n_lines", "n_removed", F.length(text).cast("bigint").alias("chars_left"), F.sha2(text, 256).alias("text_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return additive_quality.score(docs, additive_quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sequences")
    binary_packing.store(binary_packing.decompose(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), path)
    return binary_packing.placed(binary_packing.read(spark, path))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_media_chunks": op3_media_chunks,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_token_rollups": op6_token_rollups,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_binary_packing": op12_binary_packing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

#: Words are runs of anything but ASCII white space; lower() folds A-Z alone.
_SHINGLES = r"""
words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select distinct doc_id, case when len(w) < 5 then w else w[i : i + 4] end as s
  from words, lateral (select unnest(range(1, greatest(2, len(w) - 3))) as i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * k >= 75 * (x.n + y.n - k)),
edges as (select a, b from links union all select b, a from links)
"""

ORACLE_SQL: dict[str, str] = {
    "op6_token_rollups": r"""
with counts as (
  select doc_id, source, lang,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words,
    coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}|[^\x20\x09-\x0D\p{L}\p{N}]')), 0) as letters
  from documents),
kept as (select * from counts where doc_id not in (select doc_id from labels where quality = 0))
select source, lang, case when lang = 'en' then 'words-1' else 'letters-2' end as tokenizer,
  count(*)::bigint as documents, sum(case when lang = 'en' then words else letters end)::bigint as tokens
from kept group by 1, 2, 3
""",
    "op1_minhash_near_dedup": f"""
with recursive {_SHINGLES},
reach as (
  select doc_id, doc_id as r from documents
  union
  select reach.doc_id, edges.b from reach join edges on edges.a = reach.r)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join sizes s using (doc_id)
join (select doc_id, min(r) as component_id from reach group by doc_id) c using (doc_id)
""",
}
