"""Levelled increments of streaming sinks: folders and files read, lost merges, repeated batches."""

from pyspark.sql import functions as F

from botqa.streaming import increments as I
from botqa.streaming import jobs as SJ

SCHEMA = "system_hash string, pattern string, system_type string, times_used long, failures long, first_seq long, batch_id long"


def _batch(spark, n):
    rows = [("s", f"p{k}", "RAG", n + k, k, n * 10 + k) for k in range(n % 3, 4)]
    return spark.createDataFrame(rows, "system_hash string, pattern string, system_type string, times_used long, failures long, first_seq long").coalesce(1)


def _want(n):
    out = {}
    for b in range(n):
        for k in range(b % 3, 4):
            u, f, s = out.get(f"p{k}", (0, 0, 10 ** 9))
            out[f"p{k}"] = (u + b + k, f + k, min(s, b * 10 + k))
    return out


def _got(spark, out, fan=I.FAN):
    return {r.pattern: (r.times_used, r.failures, r.first_seq)
            for r in I.read_increments(spark, out, SCHEMA, SJ.merge_memory, fan).collect()}


def test_folders_and_files_stay_few_over_100_batches(spark, tmp_path):
    out, most = str(tmp_path), 0
    sink = SJ._write_increment(out, lambda d: SJ.merge_memory(d).coalesce(1))
    for n in range(100):
        sink(_batch(spark, n), n)
        paths = I.cover(spark, out, n + 1)
        most = max(most, len(paths))
        if n in (0, 6, 7, 8, 62, 63, 64, 99):
            assert _got(spark, out) == _want(n + 1)
    assert most == 14                                       # 7 batches and 7 spans of 8, before 64 of them are one
    assert len(paths) == 1 + 4 + 4                          # 64 + 4 * 8 + 4
    assert len(spark.read.schema(SCHEMA).parquet(*paths).inputFiles()) <= 9


def test_a_lost_merge_and_a_repeated_batch_change_nothing(spark, tmp_path):
    out, fan = str(tmp_path), 3

    def write(n, merge=True):
        inc = _batch(spark, n).withColumn("batch_id", F.lit(n).cast("long"))
        inc.write.mode("overwrite").parquet(f"{out}/batch_id={n}")
        if merge:
            I.compact(spark, out, SCHEMA, n, SJ.merge_memory, fan)

    for n in range(8):
        write(n)
    write(8, merge=False)
    # both merges of batch 8 are lost half way, with some rows written
    for lost in ("level=1/span=2", "level=2/span=0"):
        (spark.read.schema(SCHEMA).parquet(f"{out}/batch_id=6").write
         .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/{lost}"))
    assert [p[len(out) + 1:] for p in I.cover(spark, out, 9, fan)] == ["level=1/span=0", "level=1/span=1", "batch_id=6", "batch_id=7", "batch_id=8"]
    assert _got(spark, out, fan) == _want(9)
    write(8)                                                # the batch is run again
    assert [p[len(out) + 1:] for p in I.cover(spark, out, 9, fan)] == ["level=2/span=0"]
    assert _got(spark, out, fan) == _want(9)
    write(8)                                                # and once more, after its merges
    write(9)
    assert _got(spark, out, fan) == _want(10)
    # a batch that is being written is not read
    (_batch(spark, 10).withColumn("batch_id", F.lit(10).cast("long")).write
     .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/batch_id=10"))
    assert _got(spark, out, fan) == _want(10)


def test_counters_keep_the_latest_batch_of_a_run(spark, tmp_path):
    out = str(tmp_path)
    sink = SJ._write_increment(out, SJ.merge_counters)
    for n in range(10):
        rows = [(r, n + 1, n, 1) for r in ("a", "b", "c") if (n, r) != (9, "a") and not (r == "c" and n)]
        sink(spark.createDataFrame(rows, "run_id string, total long, passed_count long, typed_failures long").coalesce(1), n)
    got = {r.run_id: (r.total, r.batch_id) for r in I.read_increments(spark, out, SJ._COUNTERS, SJ.merge_counters).collect()}
    assert got == {"a": (9, 8), "b": (10, 9), "c": (1, 0)}


def test_no_batch_yet(spark, tmp_path):
    assert I.read_increments(spark, str(tmp_path / "none"), SCHEMA, SJ.merge_memory).count() == 0
