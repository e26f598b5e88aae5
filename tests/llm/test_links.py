"""Near-duplicate documents and lines against brute force."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from deklara.llm import edits, lineblocks, lines, linkage, minhash

EDGE = [(901, None), (902, ""), (903, " \t\n"), (904, "one two"), (905, "One  two"), (906, "one"), (907, " "), (None, "only without an id at all here"), (908, "x " * 30000)]


def copies(rng, groups, vocabulary=400):
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(vocabulary)]
    rows, k = [], 0
    for size in groups:
        base = [rng.choice(words) for _ in range(rng.randint(20, 160))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(own))
                if rng.random() < 0.5:
                    own[at] = rng.choice(words)
                else:
                    del own[at]
            rows.append((k, " ".join(own).title() if rng.random() < 0.2 else " ".join(own)))
            k += 1
    return rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rows = copies(random.Random(2), [1] * 40 + [2] * 15 + [5] * 6 + [60])
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 3)] + EDGE + [rows[5]]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = components(sets, links)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), expected[r["doc_id"]]), r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_repeated_and_missing_ids_lose_no_link(spark):
    """Rows are linked by their own texts, whatever their ids; the pipeline keeps one row of each group."""
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    texts = [[word() for _ in range(60)] for _ in range(14)]
    near = lambda t: " ".join([*t[:-1], word()])
    a, b, c, d = (" ".join(t) for t in texts[:4])
    rows = [(1, a), (1, b), (2, near(texts[1])), (None, c), (None, near(texts[2])), (None, c), (None, d), (7, near(texts[3])), (8, near(texts[3]))]
    rows += [(None, None), (None, " "), (4, ""), (4, "")]
    for i, t in enumerate(texts[4:]):
        rows += [(rng.choice([None, 20 + i, 40, 41]), near(t) if rng.random() < 0.7 else " ".join(t)) for _ in range(4)]
    sets = [shingles(t) for _, t in rows]
    linked = [(x, y) for x in range(len(rows)) for y in range(x) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    group = components(range(len(rows)), linked)
    name = {g: min((rows[x][0] for x in group if group[x] == g and rows[x][0] is not None), default=None) for g in group.values()}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("group", F.lit("x")).withColumn("node", F.lit(1))
    got = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    order = lambda rows: sorted([tuple(-1 if v is None else v for v in r) for r in rows])
    assert order(got) == order([(rows[x][0], len(sets[x]), name[group[x]]) for x in range(len(rows))])
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    texts_of = [set() for _ in rows]
    for x, (_, t) in enumerate(rows):
        texts_of[group[x]].add(t)
    stay = [[r for r in kept if r["text"] in own] for own in texts_of if own - {None, "", " "}]
    assert [len(own) for own in stay] == [1] * len(stay)
    assert sorted(str(r["text"]) for r in kept if not (r["text"] or "").strip()) == ["", " ", "None"]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, node string, key int")
    assert minhash.near_duplicates(empty).count() == 0
    assert lines.deduplicated(empty).count() == 0


def test_connected_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200 - i, 201 - i) for i in range(40)] + [(500, 900), (700, 900)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["component"] for r in linkage.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == components({n for e in edges for n in e}, edges)


def test_estimate_is_near_the_truth(spark):
    rng = random.Random(3)
    words = [str(i) for i in range(5000)]
    a = [rng.choice(words) for _ in range(800)]
    b = a[:640] + [rng.choice(words) for _ in range(160)]
    one, two = minhash.shingle_set(" ".join(a)), minhash.shingle_set(" ".join(b))
    truth = len(set(one) & set(two)) / len(set(one) | set(two))
    sketches = [minhash.folded(minhash.registers(s, 320)).view("i8").tolist() for s in (one, two)]
    row = spark.createDataFrame([tuple(sketches)], "a array<bigint>, b array<bigint>")
    assert abs(row.select(minhash.estimate(F.col("a"), F.col("b"))[0]).first()[0] - truth) < 0.12


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(7)
    texts = [t for _, t in copies(rng, [1] * 10 + [2] * 8 + [12])]
    rows = [(i, "\n".join(rng.choice(texts) for _ in range(rng.randint(1, 4))) + "\nA b, c 1!") for i in range(30)]
    return rows + [(100, None), (101, ""), (102, "---\n---"), (103, "a b c 2"), rows[3]]


def test_changed_words_against_pure_edit_distance(spark):
    """Candidates are no condition here: all pairs within the promised distance are linked."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    texts = []
    for length in (8, 10, 20, 30, 50, 100):
        for _ in range(5):
            base = [word(rng.randint(2, 7)) for _ in range(length)]
            texts.append(" ".join(base))
            for changed in (1, max(1, length // 16)):
                own = list(base)
                for at in rng.sample(range(length), changed):
                    own[at] = word(len(own[at]))
                texts.append(" ".join(own))
            at = rng.randrange(len(texts[-3]))
            texts.append(texts[-3][:at] + texts[-3][at + 1 :])
    texts += ["repeated " * 40, "repeated " * 39 + "repeatxd", "abc", "abd", "größe übel ähnlich", "größe übel ähnlixh"]
    form = {i: " ".join(*lineblocks.forms(t)) for i, t in enumerate(texts)}
    near = lambda a, b: abs(len(a) - len(b)) <= max(len(a), len(b)) * 0.1 and edit_distance(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9)
    group = components(form, [(a, b) for a in form for b in form if a < b and near(form[a], form[b])])
    found = lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in found if not r["n_removed"]} == set(group.values())


def test_lines_are_those_of_the_plain_form():
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab9ßÄ-_ \n. \t²١") for _ in range(rng.randint(0, 400))) for _ in range(60)] + [None, "", "\n", "x\n" * 40]
    expected = [(row, n, " ".join(form)) for row, t in enumerate(texts) for n, form in enumerate(lineblocks.forms(t)) if form]
    nodes, chunk = {}, lineblocks.CHUNK
    for lineblocks.CHUNK in (50, 300, chunk):
        found = []
        for parts, rows, before in lineblocks.chunks(texts):
            got, starts = lineblocks.read(parts)
            for number, node, chars in zip(got.number.tolist(), got.node.tolist(), got.chars.tolist(), strict=True):
                part = max(i for i, s in enumerate(starts) if s <= number)
                found.append((rows[part], number - starts[part] + before[part], node, chars))
        assert [f[:2] for f in found] == [e[:2] for e in expected]
        for (_, _, node, chars), (_, _, form) in zip(found, expected, strict=True):
            assert nodes.setdefault(form, node) == node and chars == len(form)
    assert len(set(nodes.values())) == len(nodes) and lineblocks.CHUNK == chunk


def test_a_block_is_the_majority_of_its_features():
    rng = np.random.default_rng(4)
    block, features = rng.integers(0, 5, 2000), rng.integers(0, 1 << 64, 300, dtype=np.uint64)[rng.integers(0, 300, 2000)]
    features[:700], block[:700] = rng.integers(0, 1 << 64, 700, dtype=np.uint64), 6  # more votes than a byte holds
    at, found, sizes = lineblocks.simhash_blocks(block, features)
    assert at.tolist() == sorted(set(block.tolist()))
    for b, h, n in zip(at.tolist(), found.tolist(), sizes.tolist(), strict=True):
        own = {f >> 24 for f in features[block == b].tolist()}
        value = 0
        for i in range(32):  # bit i of the result is bit i of the features
            value |= (4 * sum(f >> i & 1 for f in own) - 2 * len(own) + (7 - i % 8) % 2 > 0) << i
        assert (h, n) == (value, len(own))


def test_fewer_changed_features_than_half_the_blocks_leave_a_key():
    """The pigeonhole principle: each changed word disturbs the blocks of the old and the new word alone, and of 12
    blocks in a ring 4 disturbed ones leave two neighbours."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    for _ in range(200):
        base = [word() for _ in range(60)]
        own = list(base)
        for at in rng.sample(range(60), 2):
            own[at] = word()
        got, _ = lineblocks.read([" ".join(base), " ".join(own)])
        owner, keys = lineblocks.band_keys(got, np.arange(2), 0.9)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_edit_distance_is_the_plain_one():
    rng = random.Random(14)
    text = lambda n: "".join(rng.choice("abä") for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        a = text(14)
        b = text(14) if rng.random() < 0.5 else a[:4] + text(3) + a[5:]
        d, x, y = edit_distance(a, b), edits.codes_of(a), edits.codes_of(b)
        for most in range(max(0, d - 1), d + 2):
            assert edits.within(x, y, most) == (d <= most)
            assert edits.may_be_within(edits.counts_of(x), edits.counts_of(y), most) or d > most


def test_recall_against_pure_edit_distance_on_real_lines():
    """All pairs of near-equal lines of a table, found by brute force over lengths and counts: the share that
    agrees in a key."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    lines_of = sorted({" ".join(f) for t in texts for f in lineblocks.forms(t) if f}, key=len)
    codes = [edits.codes_of(t) for t in lines_of]
    counts, sizes = [edits.counts_of(c) for c in codes], [len(c) for c in codes]
    got, _ = lineblocks.read(lines_of)
    owner, keys = lineblocks.band_keys(got, np.arange(len(lines_of)), 0.9)
    held = [set() for _ in lines_of]
    for i, k in zip(owner.tolist(), keys.tolist(), strict=True):
        held[i].add(k)
    links = met = 0
    for b, n in enumerate(sizes):
        most, a = int(n * 0.1 + 1e-9), b - 1
        while a >= 0 and sizes[a] >= n - most:
            if edits.may_be_within(counts[a], counts[b], most) and edits.within(codes[a], codes[b], most):
                links += 1
                met += bool(held[a] & held[b])
            a -= 1
    assert links > 10 and met >= 0.95 * links, (links, met)


def test_lines_against_pure_edit_distance(spark, line_rows):
    docs = {i: t for i, t in line_rows}
    forms = {(i, n): " ".join(form) for i, t in docs.items() for n, form in enumerate(lineblocks.forms(t)) if form}
    classes = sorted(set(forms.values()))
    near = lambda a, b: abs(len(a) - len(b)) <= max(len(a), len(b)) * 0.1 and edit_distance(a, b) <= int(max(len(a), len(b)) * 0.1 + 1e-9)
    group = components(classes, [(a, b) for a in classes for b in classes if a < b and near(a, b)])
    seen, gone = set(), {i: 0 for i in docs}
    for at in sorted(forms):
        gone[at[0]] += group[forms[at]] in seen
        seen.add(group[forms[at]])
    found = lines.deduplicated(spark.createDataFrame(line_rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == gone


def test_near_duplicate_stage_keeps_rows_without_an_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "one two three four five"), (None, "six seven eight nine ten"), (None, "six seven eight nine ten"), (None, None), (None, " ")]
    found = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert found.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4], rows[6], rows[7]]))


def test_the_estimate_misses_fewer_pairs_than_the_bands():
    """The chance that a pair at exactly 0.75 is filtered, all of 320 registers filled."""
    from math import comb, sqrt

    n, p = 320, 0.75 + 0.25 * minhash.CHANCE
    least = 0.75 - minhash.DEVIATIONS * sqrt(0.75 * 0.25 / n) - 1 / n
    missed = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if (k / n - minhash.CHANCE) / (1 - minhash.CHANCE) < least)
    assert missed < (1 - 0.75**5) ** 64


def test_edit_distances_side_by_side_are_those_of_single_pairs():
    rng = random.Random(15)
    text = lambda n: "".join(rng.choice("abcß€") for _ in range(rng.randint(0, n)))
    pairs, most = [], []
    for n in [60] * 400 + [2500] * 40:
        a = text(n)
        b = list(a)
        for _ in range(rng.randint(0, n // 8)):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
        pairs.append((edits.codes_of(a), edits.codes_of("".join(b) if rng.random() < 0.9 else text(n))))
        most.append(rng.randint(0, n // 10))
    found = edits.all_within(pairs, most)
    assert found.tolist() == [edits.within(a, b, k) for (a, b), k in zip(pairs, most, strict=True)] and 50 < found.sum() < 400
    assert edits.all_within([], []).tolist() == []


def test_members_of_one_group_do_not_meet_in_a_large_key(spark):
    """A key that all share, and small keys that hold the links: no pair of a group is made once the group is known."""
    n, tried = 120, []
    keys = [(i, 0) for i in range(n)] + [(i, 1 + j) for j in range(n) for i in (j, j + 1) if i < n]

    def verify(pairs):
        tried.append(pairs.count())
        return pairs.where("b - a = 1 and a % 40 <> 39")

    def rest(rows, large=True):
        own = rows.where(F.col("large") == large) if "large" in rows.columns else rows
        other = own.select("key", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "main")))
        met = own.where("not main").join(other, "key").where("component <> other_component and (other_main or node < other_node)")
        return met.select(F.col("node").alias("a"), F.col("other_node").alias("b"))

    table = spark.createDataFrame(keys, "node bigint, key bigint")
    found = {r["node"]: r["component"] for r in linkage.groups(table, lambda _: linkage.Rule(verify, rest, turns=2)).collect()}
    assert len({tuple(sorted(i for i in found if found[i] == c)) for c in found.values()}) == 3 and len(found) == n
    assert max(tried[:-1]) <= n * 4 and tried[-1] <= 40 * 40 * 3  # three groups of 40: only pairs between groups are left


def test_keys_of_a_long_line_are_made_at_once(monkeypatch):
    """Lines have more blocks the longer they are: the steps of making keys must not grow with them."""
    rng = random.Random(21)
    steps, mixed = [], lineblocks.mixed
    monkeypatch.setattr(lineblocks, "mixed", lambda h: steps.append(len(h)) or mixed(h))
    found = []
    for n in (100, 20_000):
        got, _ = lineblocks.read([" ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(n))])
        steps.clear()
        owner, keys = lineblocks.band_keys(got, np.arange(1), 0.9)
        found.append((len(steps), len(set(keys.tolist()))))
    (few, short), (many, long) = found
    assert long > 50 * short and many <= 2 * few


def test_only_the_lines_asked_for_are_hashed_again(monkeypatch):
    """Wanted and removed lines are known by their numbers; a row that repeats an id with another text has other lines there."""
    import pyarrow as pa

    texts = ["one two\n--\nthree\nfour", "other\n\nthree\nfour", None, "five"]
    nodes = {form: lineblocks.read([form])[0].node.view(np.int64)[0].item() for form in ("one two", "three", "four")}
    seen, read = [], lineblocks.read
    monkeypatch.setattr(lineblocks, "read", lambda parts: seen.extend("\n".join(parts).split("\n")) or read(parts))
    asked = [{"line": 0, "node": nodes["one two"]}, {"line": 2, "node": nodes["three"]}, {"line": 9, "node": nodes["four"]}]
    kind = pa.list_(pa.struct([("line", pa.int32()), ("node", pa.int64())]))
    given = pa.array([asked, asked, asked, None], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), given.slice(0, 3).take(pa.array([0, 1, 2, 2]))], names=["text", "wanted"])
    forms = [r for b in lines._wanted_forms(iter([batch.slice(0, 3)])) for r in b.to_pylist()]
    assert sorted((r["node"], r["form"], r["size"]) for r in forms) == sorted([(nodes["one two"], "one two", 7), (nodes["three"], "three", 5), (nodes["three"], "three", 5)])
    batch = pa.RecordBatch.from_arrays([pa.array([{"text": t} for t in texts]), given], names=["row", "removed"])
    (out,) = [b.to_pylist() for b in lines._without(iter([batch]))]
    assert [(r["clean"], r["n_lines"], r["n_removed"]) for r in out] == [("--\nfour", 3, 2), ("other\n\nfour", 3, 1), (None, 0, 0), ("five", 1, 0)]
    assert set(seen) <= {"one two", "three", "other", ""}
