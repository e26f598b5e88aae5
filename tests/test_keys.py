"""Records of repeated keys."""

from deklara.operators import keys


def test_records_of_a_hot_key_come_in_bounded_lists(spark):
    rows = [(i, "hot", "1") for i in range(1, 26)] + [(26, "two", "1"), (27, "one", "1"), (28, "two", "1"), (29, "", "1"), (30, "", "1")]
    table = spark.createDataFrame(rows, "_ordinal bigint, c0 string, c1 string").repartition(3)
    found = keys.duplicates(table, ["c0", "c1"], most=10).collect()
    lists = sorted([int(o) for o in r["records"].split(", ")] for r in found if r["key"] == "hot|1")
    assert [len(x) for x in lists] == [10, 10, 5] and sum(lists, []) == list(range(1, 26))
    assert {(r["key"], r["n"], r["first"]) for r in found} == {("hot|1", 25, 1), ("two|1", 2, 26)}
    assert [r["records"] for r in found if r["key"] == "two|1"] == ["26, 28"]
    assert {tuple(r) for r in keys.duplicates(table, ["c0", "c1"]).collect()} >= {("two|1", 2, 26, "26, 28")}
    assert keys.duplicates(table.where("c0 = 'one'"), ["c0", "c1"]).count() == 0
