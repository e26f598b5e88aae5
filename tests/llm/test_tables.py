"""Round trips and exact results: media, rollups, packing, pieces, and the pipeline."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from deklara.llm import media, packing, pieces, rollups, subwords  # noqa: E402
from deklara.llm.common import scratch_path  # noqa: E402

EDGE = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (4, "ä" * 40000), (5, "word " * 20000), (6, "<|endoftext|> a")]


def test_media_round_trip(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = EDGE + [(10 + i, "".join(rng.choice("klmnop ") for _ in range(3000)) + passage) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    root = scratch_path(spark, "media")
    media.store(docs, root)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], bytes(r["payload"])) for r in media.read(spark, root).collect())
    assert got == sorted((i or -1, len((t or "").encode()), media.payload_of(t)) for i, t in rows)
    shared = spark.read.parquet(f"{root}/shared")
    assert shared.count() == shared.select("digest").distinct().count() and shared.count() >= 3
    own = sum(len(r["own"]) for r in spark.read.parquet(f"{root}/recipes").where("doc_id >= 10").collect())
    assert own < 20 * 5500  # the passage's chunks are not in the recipes
    found = media.digests(spark, root).collect()
    by_id = {i: t for i, t in rows}
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.read(spark, root).collect()}
    for r in found:
        p = media.payload_of(by_id[r["doc_id"]])
        m = p + len(p).to_bytes(8, "little") + b"SMP8"
        bands = [sum(b >> 5 == k for b in p) for k in range(8)]
        assert stored[r["doc_id"]] == m and (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
        assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p))
        assert r["feature"] == f"chunks={len(media.cuts(m))};sum={sum(p)};max={max(p)};bands={','.join(map(str, bands))}"
    empty = scratch_path(spark, "media")
    media.store(docs.limit(0), empty)
    assert media.digests(spark, empty).count() == 0
    with pytest.raises(ValueError):
        media.samples_of(b"abc" + (4).to_bytes(8, "little") + b"SMP8")


def test_media_cuts_follow_content():
    rng = random.Random(2)
    body = bytes(rng.randrange(256) for _ in range(60000))
    a, b = {d for d, _ in media.chunks(body)}, {d for d, _ in media.chunks(b"inserted in front" + body)}
    assert len(a & b) > 0.8 * len(a)
    assert all(len(c) <= media.MOST for _, c in media.chunks(b"\0" * 50000))
    with pytest.raises(ValueError):
        media.assemble(hashlib.sha256(b"y").digest(), [1], [False], b"x", [])


def test_rollup_counts_a_batch_once(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "source string, lang string, tokenizer string, tokens bigint, sign int")
    rollup = rollups.Rollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    first = rows(("s", "en", "v1", 5, 1), ("s", "en", "v1", 7, 1), (None, None, "v1", None, None))
    assert rollup.add("b1", first) and not rollup.add("b1", first)
    assert rollup.add("b2", rows(("s", "en", "v1", 7, -1), ("s", "en", "v2", 9, 1)))
    expected = {("s", "en", "v1", 1, 5), ("s", "en", "v2", 1, 9), (None, None, "v1", 1, 0)}
    assert {tuple(r) for r in rollup.totals().collect()} == expected
    rollup.compact()
    assert not rollup.add("b2", first) and rollup.batches() == ["b1", "b2"]
    assert {tuple(r) for r in rollup.totals().collect()} == expected
    assert rollup.add("b3", rollups.revised(rows(("s", "en", "v1", 5, 1)), rows(("s", "en", "v2", 6, 1)))) and rollup.add("b4", first.limit(0))
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "v2", 2, 15), (None, None, "v1", 1, 0)}
    with pytest.raises(ValueError):
        rollup.add("../b", first)


def best(sizes, capacity):
    """The fewest bins, by trying."""
    found = [len(sizes)]

    def put(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for room in set(bins):
            if room >= sizes[i]:
                rest = list(bins)
                rest.remove(room)
                put(i + 1, [*rest, room - sizes[i]])
        put(i + 1, [*bins, capacity - sizes[i]])

    put(0, [])
    return found[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        fixed, left = packing.dominance_reduction(counts, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + best(sorted(rest, reverse=True), 20) == best(sizes, 20)
        total = dict(left)
        for content, n in fixed:
            for s in content:
                total[s] = total.get(s, 0) + n
        assert total == counts


def test_reduction_fixes_three_pieces():
    assert packing.dominance_reduction({12: 2, 5: 2, 3: 2}, 20) == ([((12, 5, 3), 2)], {})
    # Two of 4 exceed 5 together, and both exceed 3: nothing is proved of 12 there.
    assert packing.dominance_reduction({12: 1, 5: 1, 4: 2, 3: 1}, 20)[0] == []
    found, rng = 0, random.Random(9)
    for _ in range(150):
        sizes = [rng.randint(4, 16) for _ in range(8)]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, left = packing.dominance_reduction(counts, 20)
        found += any(len(content) == 3 for content, _ in fixed)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + best(rest, 20) == best(sorted(sizes, reverse=True), 20)
    assert found


def test_packing_is_gapless_and_whole(spark):
    rng = random.Random(4)
    rows = EDGE + [(100 + i, " ".join(rng.choice(["alpha", "beta,", "gamma."]) for _ in range(rng.randint(0, 900)))) for i in range(80)]
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).withColumn("part", F.lit("x")).withColumn("own", F.lit(1))
    got = packing.pack(docs, path, 512).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    expected = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        expected += [(i or -1, p, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for p, s in enumerate(range(0, len(ids), 512))]
    assert sorted((r["doc_id"] or -1, *r[1:5]) for r in got) == sorted(expected)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r["length"] for r in got) // 512) + 2
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), path).count() == 0


def test_words_alone_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words, rng = Tokenizer.from_file(path), subwords.WordIds(path, True, max_words=50), random.Random(5)
    alphabet = list("abcXYZéÄß'’.,-! \n ́日1²") + ["<|endoftext|>", "'LL", "don't", "ΣΑΣ"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(words.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_are_kept_from_the_second_time_on():
    words = subwords.WordIds(public_tokenizers.path("word_bpe_49k.json"), True, once=False)
    first = words.of("some words, once")
    assert not words and words.of("some words, once") == first and len(words) >= 3
    assert words.of("some words, once") == first
    every = subwords.WordIds(public_tokenizers.path("word_bpe_49k.json"), True)
    assert every.of("some words, once") == first and len(every) >= 3


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model(path, max_words=200), random.Random(6)
    alphabet = list("abcdeéß日 ▁\n\t.'-01") + ["the", "ing", "😀", "   "]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = memoryview(model.encode(text)).cast("I").tolist()
        assert ids == library.encode(text) and model.decode(ids) == library.decode(ids), text
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 197, 172, 229, 259, 264, 28705, rng.randrange(32000)]) for _ in range(rng.randint(1, 10))]
        assert model.decode(ids) == library.decode(ids), ids
    rows = spark.createDataFrame(EDGE, "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encode_digests(rows, path).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i or -1, [*library.encode(t or ""), 2]) for i, t in EDGE]
    assert got == sorted((i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in ids)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(rows, path), path).collect()}
    assert back[4] == "ä" * 40000 and back[6] == "<|endoftext|> a"


def test_pipeline_stages_follow_each_other(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in after.collect()}
        assert set(rows) <= set(before) and len(rows) == after.count()
        if name == "line dedup":
            assert set(rows) == set(before) and any(rows[i] != before[i] for i in rows)
        else:
            assert all(rows[i] == before[i] for i in rows)
        before, docs = rows, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(before)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "line dedup", "near-duplicates", "packing"]
