"""Statistics and trained models: brute force for counts, held-out accuracy for models."""

import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from deklara.llm import additive_quality, boosted_rules, docstats, languages, lines, toxicity
from deklara.llm.docstats import FEATURES

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, doubled = set(), 0
    for line in text.split("\n"):
        doubled += bool(re.search(r"[^\x20\x09-\x0d]", line)) and line in seen
        seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered)]


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 50, "l\nl\n \n \nl", "#|<> é \x1c y", "a " * 40000])
def test_base_counts(text):
    assert docstats.statistics(text)[0] == counts(text)


def test_base_counts_of_random_texts():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", " ", "\n", "|", "c d e f g ", "\x0b"]) for _ in range(rng.randint(0, 80)))
        assert docstats.statistics(text)[0] == counts(text), text


def sample():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(FEATURES)))
    y = ((x[:, 2] < 0.5) & (x[:, 10] > 0.3) & (np.abs(x[:, 0] - 0.5) + np.abs(x[:, 1] - 0.5) < 0.7)).astype(float)
    return x, y


def test_boosted_trees_keep_their_constraints():
    x, y = sample()
    signs = np.zeros(len(FEATURES))
    signs[2], signs[10] = -1, 1
    forest = boosted_rules.train(x[:2000], y[:2000], signs)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.93
    for f in (2, 10):
        more = x.copy()
        more[:, f] += np.random.default_rng(f).random(len(x))
        assert (signs[f] * (forest.score(more) - forest.score(x)) >= -1e-12).all()


def test_additive_model_needs_its_pairs():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive_quality.train(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert additive_quality.train(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = additive_quality.score(docs, additive_quality.fit(docs, labels)).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    verdicts = boosted_rules.judge(docs, boosted_rules.fit(docs, labels)).collect()
    assert np.mean([r["kept"] <= truth[r["doc_id"]] for r in verdicts if r["doc_id"] in truth]) > 0.97
    assert all(not r["kept"] for r in verdicts if r["base_failed"])


EDGE = [(1, None, "a"), (2, "", "b"), (3, "123 !", None), (None, "text without id", "c"), (4, "word " * 30000, "d"), (4, "word " * 30000, "d")]


def test_models_on_edge_rows(spark):
    docs = spark.createDataFrame(EDGE, "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for rows in (additive_quality.score(docs, additive_quality.fit(docs, none)), toxicity.score(docs, toxicity.fit(docs, none))):
        got = rows.collect()
        assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got) and {r["held_out"] for r in got} <= {True, False}
    assert additive_quality.accepted(docs, additive_quality.fit(docs, none)).columns == docs.columns
    assert toxicity.accepted(docs, toxicity.fit(docs, none)).count() == len(EDGE)
    odd = docs.toDF("doc_id", "text", "a b`c").withColumn("row", F.lit("r"))
    assert toxicity.accepted(odd, toxicity.Scorer()).columns == odd.columns == lines.deduplicated(odd, counts=False).columns
    assert lines.deduplicated(odd, counts=False).count() == len(EDGE)
    assert boosted_rules.judge(docs.limit(0), boosted_rules.fit(docs, none)).count() == 0


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    langs, prototypes = languages.fit(docs)
    rows = languages.identify(docs, langs, prototypes).collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    edge = languages.identify(spark.createDataFrame(EDGE, "doc_id bigint, text string, lang string"), langs, prototypes).collect()
    assert [r["lang_pred"] for r in edge][:3] == ["und"] * 3 and len(edge) == len(EDGE)


def test_bundles_are_sums_of_bound_letters():
    a, b, blank = languages.letter_vectors(np.array([97, 98, 0]), 64).astype(int)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    expected = bind(blank, a, b) + bind(a, b, blank)
    assert (languages.bundles(["AB"], 64)[0] == expected).all()
    assert (languages.bundles(["ab", "1 2", "ab  ab"], 64)[1] == 0).all()


def test_letters_of_all_scripts_have_vectors_of_their_own():
    codes = np.array([c for c in range(0x110000) if chr(c).isalpha()][::7])
    assert len(np.unique(np.packbits(languages.letter_vectors(codes, 128) > 0, axis=1), axis=0)) == len(codes)


def test_languages_against_brute_force(spark):
    """Predictions and scores by plain sums over each place of a text, in scripts of many and of few letters."""
    rng = random.Random(8)
    scripts = {"aa": "abcde fgh", "el": "αβγδ εζη", "zh": [chr(c) for c in range(0x4E00, 0x5200)], "xx": "abαβ 中文"}
    make = lambda lang, n: "".join(rng.choice(scripts[lang]) for _ in range(n))
    rows = [(i, make(lang, rng.choice([0, 1, 5, 40, 300])), lang) for i, lang in enumerate([*scripts] * 30)]
    rows += [(500, make("zh", 3000) * 150, "zh"), (501, None, "aa"), (502, "12 3", None), (502, "ÀB", None), (None, "abc", "el")]
    vector = cache(lambda c: languages.letter_vectors(np.array([c]), 256)[0].astype(float))
    known = {}

    def plain(text):
        letters = [0]
        for c in (text or "").lower() + " ":
            if c.isalpha() or letters[-1]:
                letters.append(ord(c) if c.isalpha() else 0)
        total = np.zeros(256)
        for x, y, z in zip(letters, letters[1:], letters[2:]):
            if (x, y, z) not in known:
                known[x, y, z] = np.roll(vector(x), 2) * np.roll(vector(y), 1) * vector(z)
            total += known[x, y, z]
        return total

    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    sums = [plain(t) for _, t, _ in rows]
    learned = {}
    for (i, text, lang), v in zip(rows, sums, strict=True):
        if i is not None and lang and text is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            learned[lang] = learned.get(lang, 0) + unit(v)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("x"))
    langs, prototypes = languages.fit(docs, dimensions=256)
    assert langs == sorted(learned)
    got = sorted((r["doc_id"] or -1, r["lang_pred"], r["score"]) for r in languages.identify(docs, langs, prototypes).collect())
    expected = []
    for (i, _, _), v in zip(rows, sums, strict=True):
        cosines = {lang: float(unit(v) @ unit(learned[lang])) for lang in langs}
        best = max(langs, key=cosines.get)
        expected.append((i or -1, best, max(0, cosines[best])) if v.any() else (i or -1, "und", 0.0))
    for g, e in zip(got, sorted(expected), strict=True):
        assert g[:2] == e[:2] and abs(g[2] - e[2]) < 1e-4
    nothing = languages.fit(docs.limit(0))
    assert nothing[0] == [] and languages.identify(docs.limit(0), langs, prototypes).count() == 0
    assert {r["lang_pred"] for r in languages.identify(docs, *nothing).collect()} == {"und"}


def test_non_negative_risk_finds_hidden_positives():
    rng = np.random.default_rng(3)
    make = lambda n, toxic: (rng.random((n, 30)) < np.where(np.arange(30) < 5, 0.5 if toxic else 0.01, 0.2)).astype(np.float32)
    positives, hidden, clean = make(300, True), make(300, True), make(2700, False)
    w, c = toxicity.minimise(positives, np.concatenate([hidden, clean]), 0.1)
    assert (make(500, True) @ w + c > 0).mean() > 0.85 and (make(500, False) @ w + c > 0).mean() < 0.06


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic = [r["predicted"] for r in rows if truth[r["doc_id"]]]
    clean = [r["predicted"] for r in rows if not truth[r["doc_id"]]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.04


def test_stages_take_each_text_once():
    """The stages that accept documents are given rows alone; features of many texts are counted in parts."""
    import pyarrow as pa

    rows = [{"text": "plain words here", "n": 1}, {"text": None, "n": 2}]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["row"])
    for scores, model in ((toxicity._scores, toxicity.Scorer({"wor": 0}, np.array([60.0]))), (additive_quality._scores, additive_quality.Additive(3.0))):
        got = pa.Table.from_batches(scores(model, 0.5, [batch]))
        assert got.column_names == ["row", "score", "predicted"] and got.column("row").to_pylist() == rows
    texts = [f"alpha{i:x} beta" for i in range(40)]
    texts = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in t) for t in texts]
    one = pa.RecordBatch.from_arrays([pa.array([i % 3 == 0 for i in range(40)]), pa.array(texts)], names=["positive", "text"])
    whole = list(toxicity._counts([one]))
    before, toxicity.MOST = toxicity.MOST, 20
    try:
        parts = list(toxicity._counts([one]))
    finally:
        toxicity.MOST = before
    assert len(whole) == 1 and len(parts) > 1 and max(p.num_rows for p in parts) < whole[0].num_rows
    total = [pa.Table.from_batches(b).group_by("feature").aggregate([("p", "sum"), ("u", "sum")]).sort_by("feature").to_pylist() for b in (whole, parts)]
    assert total[0] == total[1]
