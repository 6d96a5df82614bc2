"""The corpus pipeline on odd tables, and what each stage decides on the given ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from botqa.llm import decontaminate, mixing, quality, simhash
from botqa.llm.common import staged
from botqa.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _odd(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `_row` string, shard string, ratio double"
    spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    for name, schema, values in (("labels", "doc_id long, quality int, toxic int", [(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)]),
                                 ("benchmark", "item_id long, text string", [(1, "one two three four five six seven"), (2, None), (3, "")]),
                                 ("conversations", "conv_id long, turn long, role string, text string", [(1, 0, "user", None), (None, None, None, "x")]),
                                 ("pages", "page_id long, url string, html string, digest string, first string, payload string",
                                  [(1, "u", "<p>" * 50, "d", "f", "p"), (2, None, "<p>" * 50, None, None, None), (2, None, "<p>" * 50, None, None, None),
                                   (None, None, None, None, None, None), (3, "u", "", "d", "f", "p"), (4, "v", "<br>" * 500_000, "d", "f", "p")])):
        spark.createDataFrame(values if rows else [], schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_every_query_on_odd_tables(spark, tmp_path, kind):
    rows = [(1, "a plain text of some words", "en", "s", 1), (1, "a plain text of some words", "en", "s", 1), (2, "BAD!! " * 50, None, None, None),
            (None, None, None, None, None), (None, "x", "en", "s", 1), (3, "", "en", "", 0),
            (4, "say one two three four five six seven now", "en", "s", 2), (5, "very long " * 30_000, "en", "t", 3)]
    folder = str(tmp_path)
    _odd(spark, folder, rows if kind == "odd" else [])
    for name, query in QUERIES.items():
        n = query(spark, folder).count()
        if name.startswith(("op2", "op4", "op5", "op7", "op8", "op9", "op10")):
            assert n == (len(rows) if kind == "odd" else 0), name
        if name.startswith("op11"):
            assert n == (6 if kind == "odd" else 0), name
        if name.startswith("op12"):
            assert n == (6 if kind == "odd" else 0), name  # the pairs of the three sources of en
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, docs, folder), f"odd{i}")
        if i < 4:
            assert out.columns == docs.columns, name
            docs = out
        else:
            assert out.count() == docs.count()


def test_stages_decide_as_their_operators(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(x[0] for x in df.select("doc_id").collect())
    labels, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("labels", "benchmark"))

    kept = staged(stage["quality classifier"](spark, docs, SF01), "t1")
    assert kept.columns == COLUMNS
    assert ids(kept) == ids(quality.quality_scores(docs, labels).where("keep"))
    judged = kept.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert judged > 0.99

    single = staged(stage["SimHash near-dedup"](spark, kept, SF01), "t2")
    found = simhash.near_duplicates(kept)
    assert ids(single) == ids(found.where("doc_id = component_id")) and single.columns == COLUMNS

    clean = staged(stage["benchmark decontamination"](spark, single, SF01), "t3")
    assert decontaminate.contained_items(clean, items).count() == 0
    hits = {x[0] for x in decontaminate.contained_items(single, items).select("doc_id").collect()}
    assert ids(clean) == [x for x in ids(single) if x not in hits] and hits

    mixed = staged(stage["mixing sources to target weights"](spark, clean, SF01), "t4")
    assert mixed.columns == COLUMNS
    copies = {x["doc_id"]: x["copies"] for x in mixing.place(mixing.sized(clean)).collect()}
    got = {x["doc_id"]: x["count"] for x in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}

    dealt = stage["sharding"](spark, mixed, SF01).collect()
    assert len(dealt) == mixed.count()
    for s in range(corpus_pipeline.SHARDS):
        slots = sorted(x["slot"] for x in dealt if x["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(dealt) / corpus_pipeline.SHARDS) < 1


def test_reruns_agree(spark):
    rows = lambda: sorted(map(str, corpus_pipeline.run(spark, SF001).collect()))
    assert rows() == rows()
