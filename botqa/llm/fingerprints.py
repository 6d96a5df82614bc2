"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols (its UTF-8 bytes).  Deterministic coin tossing
cuts it: runs of one symbol become one symbol; a symbol's label is the place and
value of the lowest bit in which it differs from its left neighbour, and labels
of labels shrink the alphabet to a few values; phrases start at the local maxima
of the labels.  A phrase's name is a hash of its symbols, and the names are the
symbols of the next level.  Where a phrase starts depends on a few symbols to its
left and right only, so equal substrings get equal phrases in their interior,
wherever they stand.

The fingerprint is the bottom-k sketch of the names from ``LEVEL`` upward (and of
the last level, so that short texts have one); likeness is the share of common
minima, an estimate of the Jaccard similarity of the name sets.

Edges: null counts as empty, whose fingerprint is the empty string; two empty
texts have likeness 1; equal texts have equal fingerprints; documents with equal
ids follow each other by the hash of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged

#: Names of this level and above enter the sketch, of so many minima.
LEVEL, MINIMA = 2, 64


def _lowest_difference(x: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """2 * place + value of the lowest bit in which each entry differs from the
    one before; the first of a text (``fixed``) gets its own lowest bits."""
    left = np.concatenate([x[:1], x[:-1]])
    diff = np.where(fixed, ~x & (x + x.dtype.type(1)), x ^ left)
    low = diff & (~diff + x.dtype.type(1))
    place = np.bitwise_count(low - x.dtype.type(1))
    return (2 * place + ((x & low) != 0)).astype(np.uint8)


def phrase_starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a phrase starts at each symbol.  ``first`` marks the first symbols
    of texts; neighbours in a text differ."""
    label = _lowest_difference(x, first)
    for _ in range(3):
        label = _lowest_difference(label, first)
    left = np.concatenate([label[:1], label[:-1]])
    right = np.concatenate([label[1:], label[-1:]])
    last = np.concatenate([first[1:], [True]])
    peak = (label > left) & (label >= right) & ~last
    peak[1:] &= ~peak[:-1]
    # a phrase has two symbols at least: none starts at the second of a text
    peak[1:] &= ~first[:-1]
    return peak | first


def _squeeze(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Make each run of one symbol a single symbol named by symbol and length."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | first[1:]
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(x))).astype(np.uint64)
    name = x[at].astype(np.uint64)
    some = np.flatnonzero(run > 1)
    name[some] = mix64(name[some] + (run[some] << np.uint64(32)) + np.uint64(0xA5))
    return name, first[at]


def _names(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each phrase (start to next start)."""
    at = np.flatnonzero(starts)
    place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
    return mix64(np.add.reduceat(mix64(x + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at))


def sketches(texts: list[bytes], level: int = LEVEL, minima: int = MINIMA) -> list[np.ndarray]:
    """The smallest 32-bit hashes, ascending, of the names of each text."""
    lengths = np.array([len(t) for t in texts])
    x = np.frombuffer(b"".join(texts), np.uint8)
    full = np.flatnonzero(lengths)
    first = np.zeros(len(x), bool)
    first[(np.cumsum(lengths) - lengths)[full]] = True
    row = full
    kept_rows, kept_names = [], []
    depth = 0
    while len(x):
        x, first = _squeeze(x, first)
        starts = phrase_starts(x, first) if len(x) > 1 else first
        x, first = _names(x, starts), first[starts]
        depth += 1
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(x)))
        done = size == 1
        if depth >= level or done.any():
            take = np.repeat(np.ones(len(row), bool) if depth >= level else done, size)
            kept_rows.append(np.repeat(row, size)[take])
            kept_names.append((mix64(x[take]) >> np.uint64(32)).astype(np.uint32))
        if done.all():
            break
        left = np.repeat(~done, size)
        x, first, row = x[left], first[left], row[~done]
    if not kept_rows:
        return [np.zeros(0, np.uint32) for _ in texts]
    rows, names = np.concatenate(kept_rows), np.concatenate(kept_names)
    # of n names the smallest lie below about minima / n: sort those first, the rest only where repeats leave too few
    many = np.bincount(rows, minlength=len(texts))
    low = names < np.minimum(2.0 ** 32 * 2 * minima / np.maximum(many, 1), 2.0 ** 32)[rows]
    key = np.unique((rows[low].astype(np.uint64) << np.uint64(32)) | names[low])
    few = np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(texts)) < np.minimum(minima, many)
    if (few & (many > 2 * minima)).any():
        again = few[rows]
        key = np.union1d(key, (rows[again].astype(np.uint64) << np.uint64(32)) | names[again])
    bounds = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return [key[a:min(b, a + minima)].astype(np.uint32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, minima: int = MINIMA) -> float:
    """Share of the smallest hashes of both together that both have."""
    if not len(a) and not len(b):
        return 1.0
    # below the smaller of the largest minima both sketches are complete
    both = np.union1d(a, b)[:minima]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)


def as_bytes(sketch: np.ndarray) -> bytes:
    """Four bytes per minimum, eight hex digits in the result."""
    return sketch.astype(">u4").tobytes()


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


#: Bytes of text that are parsed together.
_TOGETHER = 1 << 17
_RESULT = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "binary"), ("fingerprint", "binary"), ("edited_fingerprint", "binary"),
           ("near_edited", "double"), ("near_next", "double")]


def _compare(ids: list, texts: list[str]) -> list[tuple]:
    """A result row for each document but the last, each compared with the next."""
    edited = [_edited(a, b).encode() for a, b in zip(texts[:-1], texts[1:], strict=True)]
    prints = sketches([t.encode() for t in texts])
    others = sketches(edited)
    return [(ids[i], len(texts[i]), hashlib.sha256(edited[i]).digest(), as_bytes(prints[i]), as_bytes(others[i]),
             likeness(prints[i], others[i]), likeness(prints[i], prints[i + 1])) for i in range(len(edited))]


def _record(rows: list[tuple], edge: str | None = None, text: str | None = None, place: int = 0) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_RESULT)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    arrays = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, _RESULT, strict=True)]
    n = len(rows)
    arrays += [pa.array([place] * n, pa.int64()), pa.array([edge] * n, pa.string()), pa.array([text] * n, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [*(c for c, _ in _RESULT), "place", "edge", "text"])


def _parse_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of a sorted partition, and its first and last document, whose
    neighbours are elsewhere, as rows with ``edge``."""
    ids, texts, size, place = [], [], 0, None
    for batch in batches:
        for doc, text, where in zip(batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist(),
                                    batch.column("place").to_pylist(), strict=True):
            if place is None:
                place = where
                yield _record([(doc, *[None] * 6)], "first", text, place)
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size > _TOGETHER and len(ids) > 1:
                yield _record(_compare(ids, texts))
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if place is not None:
        if len(ids) > 1:
            yield _record(_compare(ids, texts))
        yield _record([(ids[-1], *[None] * 6)], "last", texts[-1], place)


def _parse_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _record(_compare([row["doc_id"], None], [row["text"] or "", row["next_text"] or ""])).drop_columns(["place", "edge", "text"])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """For each document (``doc_id``, ``text``) its fingerprint, that of its
    edited text (the last third replaced by the start of the next document) and
    their likeness, and its likeness to the next; next is by descending id, after
    the last comes the first.

    One range partitioning sorts the texts; a task compares neighbours as it
    reads them.  The last document of a partition meets the first of the next
    partition in a second, small step over one pair per partition.
    """
    spec = ", ".join(f"{c} {k}" for c, k in _RESULT)
    keys = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(*keys).sortWithinPartitions(*keys)
               .withColumn("place", F.monotonically_increasing_id()))
    parsed = staged(ordered.select("doc_id", "text", "place").mapInArrow(_parse_partition, f"{spec}, place long, edge string, text string"),
                    "fingerprints")
    edges = parsed.where("edge is not null").select("place", "edge", "doc_id", "text")
    # places of partitions, in order: the next partition's first document, after the last that of the first
    turn = edges.where("edge = 'first'").select("place").selectExpr(
        "place", "coalesce(lead(place) over (order by place), min(place) over ()) as next_place")
    pairs = (edges.where("edge = 'last'").join(turn, "place").select("doc_id", "text", "next_place")
             .join(edges.where("edge = 'first'").select(F.col("place").alias("next_place"), F.col("text").alias("next_text")), "next_place"))
    rest = pairs.select("doc_id", "text", "next_text").mapInArrow(_parse_pairs, spec)
    found = parsed.where("edge is null").select([c for c, _ in _RESULT]).unionByName(rest)
    return found.select([F.lower(F.hex(c)).alias(c) if k == "binary" else c for c, k in _RESULT])
