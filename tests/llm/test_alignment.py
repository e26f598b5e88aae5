"""Binary packing and alignment against the libraries and brute force."""

import gc
import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from deklara.llm import alignment, binary_packing, queries  # noqa: E402
from deklara.llm.common import scratch_path  # noqa: E402

WORDS, BYTES, PIECES = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
EDGE = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "no id"), (4, "ä" * 9000), (5, "word " * 9000), (6, "<|endoftext|> a</s>"), (7, "a▁b"), (8, "   "), (9, "\n\t x　y\r\n")]


def test_lengths_are_binary_digits():
    for n in range(1, 5000):
        own = binary_packing.binary_lengths(n, 2048)
        assert sum(own) == n and own == sorted(own, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in own)
        assert len([x for x in own if x < 2048]) == len({x for x in own if x < 2048})


def test_sequences_are_whole_and_unpadded(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = EDGE + [(100 + i, " ".join(rng.choice(["alpha", "beta,", "Gamma."]) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id bigint, text string, sequence_id string, length int").repartition(3)
    path = scratch_path(spark, "sequences")
    binary_packing.store(binary_packing.decompose(docs, WORDS, 256), path)
    stored = binary_packing.read(spark, path)
    got = binary_packing.placed(stored).collect()
    tokenizer, expected = Tokenizer.from_file(WORDS), []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        start = 0
        for n in binary_packing.binary_lengths(len(ids), 256):
            expected.append((i or -1, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
            start += n
    assert sorted((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(expected)
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    one = binary_packing.read(spark, path, 16)
    assert {len(r["ids"]) for r in one.collect()} == {64} and "bucket" in one._jdf.queryExecution().toString()
    assert binary_packing.placed(binary_packing.decompose(docs.limit(0), WORDS)).count() == 0
    with pytest.raises(ValueError):
        binary_packing.decompose(docs, WORDS, 1000)


def brute(rows):
    """The contract, straight: libraries, bytes, sets of ends, counters."""
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BYTES)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = alignment._shown_bytes()
    vocabulary = {i: bytes(shown[c] for c in t) for t, i in json.load(open(BYTES, encoding="utf-8"))["model"]["vocab"].items() if t != "<|endoftext|>"}
    second = {i: bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in range(32000) for p in [pieces.id_to_piece(i)]}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        x, y = [vocabulary[i] for i in a], [second[i] for i in b]
        if not text or b"".join(x) != b" " + text.encode() or b"".join(y) != b" " + text.encode():
            docs.append((doc_id, 0, 0, [], ""))
            continue
        ends = [{}, {}]
        for side, tokens in enumerate((x, y)):
            at = 0
            for k, t in enumerate(tokens):
                at += len(t)
                ends[side].setdefault(at, []).append(k)
        links, shown_groups, i, j = [], [], 0, 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            m, n = ends[0][at][-1] + 1, ends[1][at][-1] + 1
            shown_groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            links += [(a[p], b[q]) for p in ends[0][at] for q in ends[1][at]]
            i, j = m, n
        counts.update(links)
        docs.append((doc_id, len(a), len(b), links, ";".join(shown_groups)))
    most = Counter()
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    for doc_id, n_a, n_b, links, text in docs:
        best = sum(counts[pair] == most[pair[1]] for pair in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        yield (doc_id, n_a, n_b, text.count("|"), len(links), best, sum(counts[pair] for pair in links), digest), text


def odd_texts(n):
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "the", " The", "ä", "ß", "中文", "😀", "12", "'s", "n't", "’", "</s>", " ", "​", "\x00", "é", "!?", "...", " ſt", "word", " running", "Straßenbahn", "\U0010ffff", "<0x41>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


KEY = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("entries", [1 << 21, 40])
def test_alignment_against_brute_force(spark, entries):
    rows = EDGE + [(100 + i, t) for i, t in enumerate(odd_texts(300))]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id bigint, text string, n_a int, block string").repartition(3)
    expected = [(e[0] or -1, *e[1:]) for e, _ in brute(rows)]
    got = [(r["doc_id"] or -1, *(r[c] for c in KEY[1:])) for r in alignment.align(docs, BYTES, PIECES, entries).collect()]
    assert sorted(got) == sorted(expected)
    texts = Counter((r["doc_id"] or -1, r["groups"]) for r in alignment.groups(docs, BYTES, PIECES).collect())
    assert texts == Counter((e[0] or -1, t) for e, t in brute(rows))


def test_alignment_of_nothing_and_of_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(empty, BYTES, PIECES).count() == 0
    rows = [(1, "x" * 250_000), (2, " " * 1500 + "y"), (3, "lang und breit " * 20_000), (4, None)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string"), BYTES, PIECES).collect()
    assert sorted(tuple(r[c] for c in KEY) for r in got) == sorted(e for e, _ in brute(rows))


def test_memory_of_windows_is_bounded():
    aligner = alignment.Aligner(BYTES, PIECES, max_windows=10, max_window=4)
    for text in odd_texts(50):
        list(aligner.documents([text]))
    assert 0 < len(aligner._windows) <= 10 and len(aligner._older) <= 10


def test_texts_without_runs_of_white_space_take_the_plain_pattern():
    from tokenizers import Tokenizer

    aligner, library = alignment.Aligner(BYTES, PIECES), Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    odd = [a + space + b for space in (" ", "\n", "\r\n", "\u00a0", "\u3000 ", "\x1c", "\x85", "  ") for a in ("", "it's", "9") for b in ("", "x", "?!", alignment._UNUSED, "<|endoftext|>")]
    for text in (t for t in [*odd, *odd_texts(200)] if t):
        ids = library.encode(" " + text, add_special_tokens=False).ids
        assert aligner.first_ids(text).tolist() == ids
        if not alignment._RUNS.search(" " + text):
            assert aligner._plain.encode_ordinary(" " + text) == ids
    list(aligner.documents(odd))
    gc.collect()
    assert aligner._windows and not any(map(gc.is_tracked, aligner._windows.values()))


def test_registered_queries_read_whole_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, sf_dir).collect()
    assert sorted(tuple(r[c] for c in KEY) for r in got) == sorted(e for e, _ in brute(rows))
    pieces = queries.QUERIES["op12_binary_packing"](spark, sf_dir).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(pieces) == len({i for i, _ in rows}) and all(r[1] % r[2] == 0 for r in pieces)
    whitened = queries.QUERIES["op11_embedding_whitening"](spark, sf_dir)
    usable = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null").count()
    assert whitened.select("vec_id").distinct().count() <= usable and whitened.agg({"identity_error": "max"}).first()[0] < 1e-9
