"""Training positions of the mix, in its query's rows and at the end of the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from botqa.llm import mixing
from botqa.llm.common import staged
from botqa.llm.queries import QUERIES


def _table(spark, folder):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "b", "b", "b", None]), rng.choice([None, "", *("w " * rng.randint(1, 90) for _ in range(6))])) for i in range(400)]
    docs += [docs[0], docs[0], (None, "a", "no id at all"), (None, "a", "no id at all")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    frame.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    return docs


def test_query_holds_every_position(spark, tmp_path):
    docs = _table(spark, tmp_path)
    rows = QUERIES["op10_training_order"](spark, str(tmp_path)).collect()
    sizes = staged(mixing.sized(spark.read.parquet(f"{tmp_path}/documents.parquet")), "sizes")
    plain = mixing.place(sizes).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
    assert [q for q in QUERIES if q.startswith("op10_")] == ["op10_training_order"]
    assert sorted(map(str, (tuple(x[c] for c in plain.columns) for x in rows))) == sorted(map(str, map(tuple, plain.collect())))
    assert len(rows) == len(docs)
    names = sorted({s for _, s, _ in docs if s is not None}) + [None]
    copies, given = [], {}
    for x in rows:
        for e in (1, 2, 3):
            assert (x[f"at_{e}"] is None) == (x[f"position_{e}"] is None) == (x["copies"] < e)
            if x["copies"] >= e:
                copies.append((x[f"position_{e}"], x[f"at_{e}"], x))
    copies.sort(key=lambda c: c[0])
    assert [p for p, *_ in copies] == list(range(len(copies))) and len(copies) > 300
    assert all(a[1] <= b[1] for a, b in zip(copies, copies[1:]))
    for _, t, x in copies:  # by the middle of a copy its source has given what the integral of its weight asks for
        tilt = mixing.TILT if names.index(x["source"]) % 2 == 0 else -mixing.TILT
        before = given.get(x["source"], 0)
        assert before + x["size"] / 2 == pytest.approx(x["target"] * ((1 - tilt) * t + tilt * t * t), abs=1e-6)
        given[x["source"]] = before + x["size"]


def test_pipeline_numbers_rows_in_training_order(spark, tmp_path):
    _table(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        mixed = staged(stage["mixing sources to target weights"](spark, docs, str(tmp_path)), "t4")
    finally:
        spark.conf.unset(coalesce)
    assert mixed.select(F.input_file_name()).distinct().count() > 1
    dealt = sorted(stage["sharding"](spark, mixed, str(tmp_path)).collect(), key=lambda x: x["row_number"])
    assert [x["row_number"] for x in dealt] == list(range(len(dealt)))
    want = sorted(mixing.timed_copies(mixing.place(mixing.sized(docs))).collect(), key=lambda x: x["at"])
    assert [(x["doc_id"], x["source"]) for x in dealt] == [(x["doc_id"], x["source"]) for x in want]


def test_rows_without_id_meet_in_no_bucket(spark):
    """10,000 rows without an id, of unlike texts: their order is spread evenly over its first digits."""
    rows = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"),
                                      F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    placed = mixing.place(mixing.sized(rows), max_repeats=1)
    assert "content" not in placed.columns and "k" not in placed.columns
    assert sorted(x["first"] for x in placed.collect()) == [2 * i for i in range(10_000)]
    held = mixing.sized(rows).groupBy(mixing.order_key().substr(1, 2).alias("bucket")).count()
    most = held.agg(F.max("count"), F.count("*")).first()
    assert most[0] < 100 and most[1] == 256
