"""Benchmark items that share an id, or have none, are items of their own."""

import pytest

from botqa.llm import decontaminate


@pytest.mark.parametrize("item_id", [7, None])
def test_unlike_texts_under_one_id(spark, item_id):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    items = spark.createDataFrame([(item_id, one), (item_id, two), (item_id, two)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"say {one} now"), (2, two), (3, f"{two} and {one}"), (4, "not any of these words here")], "doc_id long, text string")
    got = decontaminate.contained_items(docs, items).select("doc_id", "item_id", "n_item", "n_shared").collect()
    assert sorted((x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in got) == [(d, item_id, 16, 16) for d in (1, 2, 3, 3)]
    assert [x["doc_id"] for x in decontaminate.without_leaks(docs, items).collect()] == [4]
