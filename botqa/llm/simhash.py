"""SimHash near-duplicates, candidates by pigeonring filtering.

Fingerprints have 64 bits in four segments of 16; two texts link if at most
``DISTANCE`` (3) bits differ.  With four segments the quota is 3/4 of a bit each,
so on the ring of segments some chain must start with an equal segment (at most
0.75 bits) that together with the next has at most one difference (1.5), and
with the third at most two (2.25).  Chains of two are the join key: a
fingerprint is filed under segment pair (i, i+1) as it is, and looks up its own
pair and those with one more bit set in segment i+1.  Pairs that meet are tested
for the chain of three and then for the whole distance.

Copies are grouped by fingerprint first.  Fingerprints that meet under one key
are compared in blocks inside a task, and a task returns a spanning forest of
the links, not the pairs; keys with very many fingerprints are dealt out as
pairs of blocks.  Components: smallest id by rounds of star contraction.

Edges: null text counts as empty; an empty text has fingerprint zero, linked
like any other; a null ``doc_id`` never names a component (a component without
any id has null); repeated rows stay rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, staged

#: Words of a shingle, bits that may differ, and the hash's seed.
SHINGLE_WORDS, DISTANCE, SEED = 3, 3, 42
#: More fingerprints than this under one key are dealt out in blocks of about so many.
BLOCK = 4096


def fingerprint(text: str, size: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles, as a signed 64-bit integer."""
    found = text.encode().lower().split()  # bytes: A-Z only, and white space as \\x20\\x09-\\x0D
    if not found:
        return 0
    whole, end = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    first = [0, *(end[:-size].tolist() if len(found) > size else ())]
    last = (end[size - 1:] - 1).tolist() or [len(whole)]
    h = np.array([xxhash.xxh64_intdigest(whole[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo:lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def _fingerprints(text: str, out: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            yield batch.drop_columns([text]).append_column(out, pa.array([fingerprint(x.as_py(), size) for x in texts], pa.int64()))
    return run


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with its text replaced by its fingerprint (long); a column named
    ``out`` gives way to it."""
    docs = docs.drop(out)
    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(_fingerprints(text, out, size), T.StructType([*fields, T.StructField(out, T.LongType())]))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def chain_keys(prints: DataFrame) -> DataFrame:
    """(key, fp, filed): for each chain start the key a fingerprint is filed
    under, and the keys with one more bit of the second segment that it looks up."""
    fp = F.col("fp")
    rows = []
    for i in range(4):
        key = F.shiftleft(_segment(fp, i), 16).bitwiseOR(_segment(fp, i + 1)).bitwiseOR(F.lit(i << 32))
        rows.append(F.struct(key.alias("key"), F.lit(True).alias("filed")))
        rows += [F.when(key.bitwiseAND(F.lit(1 << b)) == 0, F.struct(key.bitwiseOR(F.lit(1 << b)).alias("key"), F.lit(False).alias("filed")))
                 for b in range(16)]
    return (prints.select("fp", F.explode(F.array(*rows)).alias("x")).where("x is not null")
            .select("x.key", "fp", "x.filed"))


def forest(filed: np.ndarray, looking: np.ndarray, start: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links under one key connect: each fingerprint
    that has a link, with the smallest of its component (itself left out)."""
    both = np.unique(np.concatenate([filed, looking]))
    label = np.arange(len(both))
    a, b = np.searchsorted(both, filed), np.searchsorted(both, np.concatenate([filed, looking]))
    third = np.uint64(0xFFFF << (16 * ((start + 2) % 4)))
    first3 = third | np.uint64(0xFFFF << (16 * ((start + 1) % 4)))
    x = both.astype(np.int64).view(np.uint64)
    hits = []
    for i in range(0, len(a), 1024):
        for j in range(0, len(b), 1024):
            diff = x[a[i:i + 1024], None] ^ x[None, b[j:j + 1024]]
            near = np.bitwise_count(diff & first3) <= 2 if diff.size > 64 else np.ones(diff.shape, bool)
            near &= np.bitwise_count(diff) <= distance
            p, q = np.nonzero(near)
            p, q = label[a[i + p]], label[b[j + q]]
            p, q = np.minimum(p, q), np.maximum(p, q)
            pairs = np.unique(p[p < q] * len(both) + q[p < q])
            hits.append(pairs)
            if sum(map(len, hits)) > 4 * len(both):
                label = _merged(label, np.concatenate(hits))
                hits = []
    label = _merged(label, np.concatenate(hits)) if hits else label
    at = np.flatnonzero(label != np.arange(len(both)))
    return both[at], both[label[at]]


def _merged(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after joining the pairs p * n + q."""
    p, q = np.divmod(pairs, len(label))
    while True:
        a, b = label[p], label[q]
        differ = a != b
        if not differ.any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (label[label] != label).any():
            label = label[label]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
            group, key, fp, filed = (np.concatenate(x) for x in zip(*rows, strict=True))
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            end = np.r_[cut[1:], len(group)]
            some = np.add.reduceat(filed.astype(np.int64), cut)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            two = (end - cut == 2) & (some > 0)
            u, v = fp[cut[two]], fp[cut[two] + 1]
            near = np.bitwise_count(u.view(np.uint64) ^ v.view(np.uint64)) <= distance
            found.append((np.maximum(u, v)[near], np.minimum(u, v)[near]))
            for g in np.flatnonzero((end - cut > 2) & (some > 0)):
                f, m = fp[cut[g]:end[g]], filed[cut[g]:end[g]]
                found.append(forest(f[m], f[~m], int(key[cut[g]] >> 32), distance))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            real = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[real]), pa.array(b[real])], ["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "key", "fp", "filed")]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1], "left")) if now[0][0] <= now[0][-1] else 0
            if last:
                yield edges([*rest, [x[:last] for x in now]])
                rest = [[x[last:] for x in now]]
            elif rest and rest[-1][0][-1] != now[0][-1]:
                yield edges(rest)
                rest = [now]
            else:
                rest.append(now)
        if rest:
            yield edges(rest)
    return run


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect the same sets as
    all pairs within the distance.  ``prints``: one row per fingerprint ``fp``."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the chain budgets hold for 0 to {DISTANCE} bits")
    keyed = chain_keys(prints)
    own_keys = keyed.where("filed").groupBy("key").count().where(F.col("count") > block)
    # who is filed under a very frequent key also looks up that key with one more bit
    met = F.array("key", *[F.col("key").bitwiseOR(F.lit(1 << b)) for b in range(16)])
    hot = staged(own_keys.select(F.explode(F.array_distinct(met)).alias("key"), "count")
                 .groupBy("key").agg(F.sum("count").alias("count")), "simhash-hot")
    if not hot.isEmpty():  # very many fingerprints under a key: pairs of blocks
        n = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), n)
        other = F.explode(F.sequence(F.lit(0), n - 1))
        dealt = keyed.join(hot, "key", "left").select("key", "fp", "filed", own.alias("own"), other.alias("other"))
        filed, looking = dealt.where("filed"), dealt.where("own is not null")
        keyed = (filed.select("key", "fp", "filed", F.col("own").alias("x"), F.col("other").alias("y"))
                 .unionByName(looking.where("own <> other or not filed")
                              .select("key", "fp", F.lit(False).alias("filed"), F.col("other").alias("x"), F.col("own").alias("y")))
                 .withColumn("grp", F.xxhash64("key", "x", "y")))
    else:
        keyed = keyed.withColumn("grp", F.col("key"))
    return (keyed.select("grp", "key", "fp", "filed").repartition("grp").sortWithinPartitions("grp")
            .mapInArrow(_links(distance), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that it
    reaches.  Alternates links to the smallest neighbour of larger and of smaller
    nodes, each round a written table, until every node names its root."""
    pairs = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        # large star: the larger neighbours of a node go to its smallest neighbour or itself
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = staged(small.where("a <> b").distinct(), "edges")
        # done when no node has two parents and no parent has one
        if (small.groupBy("a").count().where("count > 1").isEmpty()
                and small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()):
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        pairs = small


def _grouped(docs: DataFrame, size: int, distance: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows (doc_id, h: hash of the text, fp), and of each
    fingerprint its smallest id (least), root and component_id."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    prints = staged(with_fingerprints(rows, size=size), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    root = components(links(nodes.select("fp"), distance, block))
    named = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, staged(named.join(smallest, "root").select("fp", "least", "root", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): doc_id, fp, component_id."""
    prints, named = _grouped(docs, size, distance, block)
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """One document of each component, that of the smallest id (of rows with this
    id, the one of the smallest fingerprint, then text hash), with the columns of
    ``docs``.  Rows of one id with unlike texts are documents of their own.  Rows
    without an id can't be named as copies and stay."""
    prints, named = _grouped(docs, size, distance, block)
    first = named.where("least = component_id").groupBy("root").agg(F.min("fp").alias("fp"), F.min("least").alias("doc_id"))
    h, kept_id, kept_h = (fresh(docs, x) for x in ("h", "kept_id", "kept_h"))
    kept = (prints.join(first.select("doc_id", "fp"), ["doc_id", "fp"]).groupBy("doc_id", "fp").agg(F.min("h").alias("h"))
            .select(F.col("doc_id").alias(kept_id), F.col("h").alias(kept_h)))
    hashed = docs.where("doc_id is not null").withColumn(h, F.xxhash64("text"))
    one = (hashed.join(kept, (F.col("doc_id") == F.col(kept_id)) & (F.col(h) == F.col(kept_h)), "left_semi")
           .dropDuplicates(["doc_id", h]))
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))
