"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are sought inside long documents.  A document contains an item
if it has at least ``threshold`` of the item's distinct word shingles.  Items are
partitioned by the size of their shingle set; in a partition of sizes up to u an
item's sketch is its floor((1 - threshold) u) + 1 smallest shingle hashes.  An
item of q shingles may miss floor((1 - threshold) q) of them, so a document that
contains it must hold at least sketch size less that many of the minima: never
fewer than one, whatever the document's length.  The search therefore loses no
hit.  Documents are scanned once; only their hashes under the largest minimum of
any partition are probed against the sketches.  Candidates are then verified by
exact containment of the shingles themselves.

All of it is DataFrame expressions.  Words: lower-cased runs of characters that
aren't ASCII white space; a text of fewer words than a shingle is one shingle.

Edges: null or empty text has no shingles and neither contains nor is contained;
rows with the same id and text are one document or one item, rows with the same
id or none and unlike texts are several; an empty table on either side gives no
hits.  Limit: an item of fewer words than a shingle is found only in a document
of the same words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, staged

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: What tells items apart.
ITEM = ["item_id", "item_hash"]
#: Sketch tables up to so many rows (24 bytes each) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 500_000


def word_array(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(rows: DataFrame, keys: list[str], size: int = SHINGLE_WORDS) -> DataFrame:
    """``keys`` and the words w1.. of each shingle of ``words``, a row each."""
    many = F.greatest(F.size("words") - (size - 1), F.lit(1))
    parts = F.arrays_zip(*[F.slice("words", F.lit(i + 1), many).alias(f"w{i}") for i in range(size)])
    return rows.where(F.size("words") > 0).select(*keys, F.inline(parts))


def _words(size: int) -> list[str]:
    return [f"w{i}" for i in range(size)]


def item_shingles(items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """item_id, item_hash (of the text), the shingle's words and hash, n_item
    (distinct shingles), least (minima a document must hold) and whether the
    shingle is in the sketch."""
    rows = items.select("item_id", F.xxhash64("text").alias("item_hash"), word_array(F.col("text")).alias("words"))
    rows = shingles(rows, ITEM, size).distinct().withColumn("h", F.xxhash64(*_words(size)))
    sizes = rows.groupBy(*ITEM).agg(F.count("*").alias("n_item")).select(F.col("item_id").alias("i"), F.col("item_hash").alias("ih"), "n_item")
    rows = rows.join(sizes, (F.col("item_hash") == F.col("ih")) & F.col("item_id").eqNullSafe(F.col("i"))).drop("i", "ih")
    upper = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1  # sizes 1, 2-3, 4-7, 8-15, ...
    may_miss = lambda n: F.floor(F.round(n * (1 - threshold), 9))
    sketch = F.least(F.col("n_item"), may_miss(upper) + 1)
    rank = F.expr("row_number() over (partition by item_id, item_hash order by h)")
    return rows.select("*", (rank <= sketch).alias("in_sketch"), (sketch - may_miss(F.col("n_item"))).alias("least"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, item_id, item_hash, n_item, n_shared, containment of each document
    (``doc_id``, ``text``) and item (``item_id``, ``text``) that it contains."""
    wanted = staged(item_shingles(items, threshold, size), "items")
    sketch = wanted.where("in_sketch").select("h", *ITEM, "n_item", "least")
    n, top = sketch.agg(F.count("*"), F.max("h")).first()
    if n <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    key = ["doc_id", "text_hash"]
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    probes = (shingles(docs.select(*key, word_array(F.col("text")).alias("words")), key, size)
              .select(*key, F.xxhash64(*_words(size)).alias("h")).where(F.col("h") <= F.lit(top)))
    held = probes.join(sketch, "h").select(*key, *ITEM, "least", "h").distinct()
    candidates = staged(held.groupBy(*key, *ITEM).agg(F.count("*").alias("held"), F.first("least").alias("least"))
                        .where("held >= least").select(*key, *ITEM), "candidates")
    # exact check, on the texts of the candidates alone
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    some = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    texts = docs.join(some, same("doc_id", "d") & same("text_hash", "t"), "left_semi")
    have = shingles(texts.select(*key, word_array(F.col("text")).alias("words")), key, size).distinct()
    pairs = candidates.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("item_id").alias("i"), F.col("item_hash").alias("ih")).join(
        wanted.select(*ITEM, "n_item", *[F.col(w).alias(f"v{w}") for w in _words(size)]),
        (F.col("ih") == F.col("item_hash")) & same("i", "item_id")).drop("i", "ih")
    match = same("doc_id", "d") & same("text_hash", "t")
    for w in _words(size):
        match = match & same(w, f"v{w}")
    shared = pairs.join(have, match).groupBy(*key, *ITEM, "n_item").agg(F.count("*").alias("n_shared"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    hits = staged(contained_items(docs, items, **options).select("doc_id", "text_hash").distinct(), "leaks")
    h, leak_id, leak_hash = (fresh(docs, x) for x in ("h", "leak_id", "leak_hash"))
    hits = hits.select(F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash))
    return (docs.withColumn(h, F.xxhash64("text"))
            .join(hits, F.col("doc_id").eqNullSafe(F.col(leak_id)) & (F.col(h) == F.col(leak_hash)), "left_anti")
            .select(docs.columns))
