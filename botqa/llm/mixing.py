"""Mixing sources to target weights under a time-varying curriculum.

A source's schedule is a weight over training time 0..1, linear from ``1 - tilt``
to ``1 + tilt`` times its target share; its integral is the source's cumulative
token demand.  The source's documents, in a fixed pseudo-random order and
repeated as whole passes, offer tokens at cumulative offsets; inverting the
demand at the middle of a copy gives the training time at which it is read.
Copies whose middle lies beyond the target are not taken.  Documents are then
range-sorted by position.

Targets: all sizes are shared out by weight; a source stops at ``max_repeats``
times its size, and what is left over is shared again by weight among the others.

Prefix sums are cut into buckets of the order's hash, so a source that holds a
third of the rows is summed by many tasks.  The hash takes id and text, so rows
that share an id, or have none, spread too; only rows alike in both meet.

Edges: null text has size 0 and is never taken; null source is a source of its
own, last in order; repeated rows are documents of their own; equal rows may
swap places; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, with_row_numbers

#: Weights by source, in order of code points, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: The schedule of every second source rises by this share over training, the others fall.
TILT = 0.5
#: Rows of a source in one bucket of the prefix sums, about.
BUCKET_ROWS = 1 << 16
MIN_BUCKETS = 256


def size_in_words(text: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _content(text: Column) -> Column:
    """What parts rows of one id in the order of a source."""
    return F.md5(F.coalesce(text, F.lit("")))


def order_key() -> Column:
    """Order inside a source; its first digits are the buckets of the prefix sums."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "content"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, place, weight, target) for (source, source_size).

    Water level: each round shares what the capped sources leave among the rest
    and caps those above their limit; only sums reach the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = with_row_numbers(sizes, [F.col("source").asc_nulls_last()], "place")
    table = staged(table.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    total, mass = table.agg(F.sum("source_size"), F.sum("weight")).first()
    limit = F.col("source_size") * F.lit(float(max_repeats))
    level, capped = (total / mass if mass else 0.0), 0
    while total:
        full = F.col("weight") * F.lit(level) > limit
        n, held, free = table.agg(F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), limit))


def place(docs: DataFrame, sizes: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS,
          max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets and copies of each document of a table with ``doc_id``, ``source``,
    ``size`` and ``content`` (a hash of the text); a column ``payload`` is carried
    along.

    Adds source_size, target, place (of the source), first (the document's offset
    in a pass over its source), copies, taken.  The order inside a source is the
    MD5 of doc_id and ``content``.  ``sizes``: the same rows without payload, if cheaper to scan.
    """
    docs, narrow = (x.withColumn("k", order_key()).drop("content")
                    for x in (docs, docs if sizes is None else sizes))
    totals = staged(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "source-sizes")
    targets = staged(source_targets(totals, weights, max_repeats), "targets")
    most, digits = targets.agg(F.max("n")).first()[0] or 0, 2
    while 16 ** digits < max(MIN_BUCKETS, most / BUCKET_ROWS):
        digits += 1
    bucket = F.substring("k", 1, digits)
    sums = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    earlier = "sum(bucket_size) over (partition by source order by bucket rows between unbounded preceding and 1 preceding)"
    bases = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.expr(earlier), F.lit(0)).alias("base"))
    bases = staged(bases.join(targets.select("source", "source_size", "target", "place"), F.col("s").eqNullSafe(F.col("source")))
                   .drop("source"), "bases")
    inside = "sum(size) over (partition by source, bucket order by k, doc_id, size rows between unbounded preceding and 1 preceding)"
    placed = (docs.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.expr(inside), F.lit(0)))
              .join(bases, (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
              .withColumn("first", F.col("base") + F.col("inside")))
    # the copy of pass e is taken if its middle lies before the target: first + e * source_size + size / 2 < target
    room = F.col("target") - F.col("first") - F.col("size") / 2
    copies = F.when((F.col("size") > 0) & (room > 0), F.least(F.lit(max_repeats), F.ceil(room / F.col("source_size")))).otherwise(0)
    return (placed.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("size") * F.col("copies"))
            .drop("k", "bucket", "inside", "b", "s", "base"))


#: The order of training; ties beyond it are equal copies.
TRAINING_ORDER = ("at", "doc_id", "source", "epoch")


def timed_copies(placed: DataFrame, tilt: float = TILT) -> DataFrame:
    """A row per copy taken with its ``epoch`` and training time ``at`` (0..1)."""
    slope = F.when(F.col("place") % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    share = (F.col("first") + F.col("epoch") * F.col("source_size") + F.col("size") / 2) / F.col("target")
    # demand up to time t as a share of the target: (1 - slope) t + slope t^2; its inverse, stable near slope 0
    at = 2 * share / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share))
    return placed.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("at", at)


def copies_by_position(placed: DataFrame, tilt: float = TILT) -> DataFrame:
    """The rows of ``timed_copies``, range-sorted by ``at``."""
    return timed_copies(placed, tilt).repartitionByRange(*TRAINING_ORDER).sortWithinPartitions(*TRAINING_ORDER)


def training_positions(docs: DataFrame, max_repeats: int = MAX_REPEATS, tilt: float = TILT, **options) -> DataFrame:
    """Targets, copies and, for the copy of each pass e = 1 .. max_repeats, its
    training time at_e (0..1) and its number position_e (from 0) in the order of
    training: a row per document with ``doc_id``, ``source``, ``size`` and
    ``content``; null where a copy isn't taken."""
    placed = staged(place(docs, max_repeats=max_repeats, **options), "placed")
    copies = with_row_numbers(timed_copies(placed, tilt), [F.col(c) for c in TRAINING_ORDER], "position")
    passes = [(c, e) for e in range(max_repeats) for c in ("at", "position")]
    # documents with copies have a size, so no two of a source share an offset
    whole = copies.groupBy(*placed.columns).agg(
        *[F.max(F.when(F.col("epoch") == e, F.col(c))).alias(f"{c}_{e + 1}") for c, e in passes])
    rest = placed.where("copies = 0").select("*", *[F.lit(None).cast(copies.schema[c].dataType).alias(f"{c}_{e + 1}") for c, e in passes])
    return whole.unionByName(rest)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and content of each document."""
    return docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"), _content(F.col("text")).alias("content"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per copy, in training order,
    with the columns of ``docs``."""
    narrow = staged(sized(docs), "sizes")
    rows = docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"),
                       _content(F.col("text")).alias("content"), F.struct(*[F.col(c) for c in docs.columns]).alias("payload"))
    return copies_by_position(place(rows, narrow, **options)).select("payload.*")
