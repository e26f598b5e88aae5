"""Registered queries on small tables that a prefix or a row limit would cut."""

from deklara import plans


def test_documents_are_sorted_by_the_whole_text(spark, tmp_path):
    same = "Derselbe Anfang, der länger ist als jeder Vorspann von 40 Zeichen: "
    rows = [(0, same + "Zebra", "de", "w"), (1, same + "Äpfel", "de", "w"), (2, same + "Apfel", "de", "w"), (3, same + "apfel", "de", "w"), (4, same + "Ofen", "de", "w")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = [3, 2, 1, 4, 0]  # apfel, Apfel, Äpfel, Ofen, Zebra
    found = plans.QUERIES["sort_text_de"](spark, str(tmp_path)).orderBy("pos").collect()
    assert [r["_ordinal"] - 1 for r in found] == expected
    found = plans.QUERIES["fn_collate_de"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["doc_id"] for r in found] == expected


def test_scan_bom_returns_every_record(spark):
    sf = "/root/testdata/sf0.001"
    found = plans.QUERIES["scan_bom"](spark, sf).collect()
    keys = [r["o_orderkey"] for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").collect()]
    assert sorted((r["_ordinal"], r["c0"]) for r in found) == sorted((k + 1, str(k)) for k in keys)
