"""Helpers shared by the operators of this subpackage: written tables, global
row numbers, blocks of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time (a longer text is
#: a block of its own).
BLOCK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a single-process session (``local[...]``, as in tests) may leave it
    unset; it then gets a scratch folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and go on from that table:
    the lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name, taken = f"_{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_numbers(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the row's global number from 0 in the order of ``order``.

    A range partitioning sorts the rows; each partition is numbered locally and
    shifted by the sizes of those before it (a table of one row per partition,
    which bounds the broadcast).  Rows that tie in all of ``order`` are split by
    the scan position, so equal rows do not meet in one task.
    """
    spread, at, part, base = (fresh(df, x) for x in ("spread", "at", "part", "base"))
    keys = [*order, F.col(spread)]
    ranked = (df.withColumn(spread, F.monotonically_increasing_id())
              .repartitionByRange(*keys).sortWithinPartitions(*keys).drop(spread)
              .withColumn(at, F.monotonically_increasing_id()))
    ranked = staged(ranked, "ranked")
    in_part = F.shiftright(F.col(at), 33)
    sizes = staged(ranked.groupBy(in_part.alias(part)).agg(F.count("*").alias(base)), "sizes")
    before = F.expr(f"sum({base}) over (order by {part} rows between unbounded preceding and 1 preceding)")
    offsets = sizes.select(part, F.coalesce(before, F.lit(0)).alias(base))
    return (ranked.withColumn(part, in_part).join(F.broadcast(offsets), part)
            .withColumn(name, F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
            .drop(part, base, at))


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into blocks: (first row, end row, UTF-8 bytes,
    offsets of its rows).  Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block_bytes, "right")) - 1)
        yield lo, hi, whole[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
                      for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of the bytes, one entry more than bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0][:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans agree wherever they stand."""
    return mix64((prefix[ends] - prefix[starts]) * _powers(len(prefix) - 1)[1][starts])


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the 256-entry table ``inside`` marks, never
    across rows: (starts, ends, row of each)."""
    mark = np.zeros(len(data) + 1, bool)
    mark[:-1] = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], mark[:-1]])
    starts = np.flatnonzero(mark & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~mark))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words that ``words()`` found, told apart by their bytes: number of each,
    and the distinct words by number."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = np.ascontiguousarray(data[inside[data]])  # all bytes of words, and no others
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array."""
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


class HashFilter:
    """A bitmap of 64-bit hashes: ``has`` is never false for a hash that was put
    in.  Its size follows the number of hashes, up to ``MAX_BITS`` (2**26, 8 MB):
    a broadcast of bounded size.  A fuller bitmap lets more others pass; callers
    count exactly afterwards, so results don't depend on it."""

    MAX_BITS = 26

    def __init__(self, hashes: DataFrame, column: str = "h"):
        n = hashes.count()
        self.bits = min(self.MAX_BITS, max(16, (16 * n).bit_length()))
        place = F.shiftrightunsigned(F.col(column), 64 - self.bits)
        words = (hashes.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at"))
                 .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("word"))).toArrow()
        self.table = np.zeros(1 << (self.bits - 6), np.uint64)
        self.table[words["at"].to_numpy()] = words["word"].to_numpy().view(np.uint64)
        self.count = n

    def has(self, h: np.ndarray) -> np.ndarray:
        p = h >> np.uint64(64 - self.bits)
        return (self.table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0


def joined_to_unique(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """``rows`` left joined to ``table`` (one row per ``key``, the key not null).

    ``counts`` (key, n) says how many rows have a key; keys that it leaves out must
    be rare.  Keys with more than one row in ``share`` are fewer than ``share``:
    their rows of ``table`` are broadcast, and the rows that have them stay where
    they are, as do rows without a key.  The rest is shuffled by a key of few rows.
    """
    if counts is None:
        counts = staged(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot_key, added = fresh(rows, "hot"), [c for c in table.columns if c != key]
    hot = staged(counts.where(F.col("n") * share > total).select(key).join(table, key, "left"), "hot-keys")
    marked = rows.join(F.broadcast(hot.withColumn(hot_key, F.lit(True))), key, "left")
    stay = marked.where(F.col(hot_key) | F.col(key).isNull())
    rest = marked.where(F.col(hot_key).isNull() & F.col(key).isNotNull()).select(rows.columns).join(table.hint("merge"), key, "left")
    return stay.select(*rows.columns, *added).unionByName(rest.select(*rows.columns, *added))


#: Bytes that are not ASCII white space.
NOT_SPACE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
