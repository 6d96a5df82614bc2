"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are compared: one of target text
(labelled good documents), one of raw text (all documents).  The log ratio of
the two, per n-gram, is a document's log importance weight; Gumbel top-k draws
the documents to keep, without replacement and in proportion to the weights.

Steps: (1) one pass counts buckets over all documents, (2) one pass scores
every document, (3) k is the number of documents whose ratio lies on the good
side of the cut that parts the labelled sample best, and the k-th largest key
is found by counting digits, never by a global sort.

Edges: null or empty text has no n-grams and ratio 0; null ``doc_id`` draws the
noise of a null; repeated rows get equal keys and ties at the k-th key all stay;
without labels of both kinds no cut can be fitted and all rows stay; an empty
table gives an empty result.  Other columns of ``docs`` pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, fresh, mix64, prefix_hash, span_hash, staged, text_blocks, words

#: Hash buckets of the n-gram models (their counts are what reaches the driver).
BUCKET_BITS = 16
#: Most labelled rows that the target model and the cut are fitted on.
SAMPLE_ROWS = 20_000
#: Pseudo-counts of the raw distribution in the target model.
PRIOR = 10_000.0
#: A document weighs as if it had so many n-grams (length normalisation).
EFFECTIVE_LENGTH = 20.0
#: Keys are compared as integers of this many units per nat.
KEY_UNITS = 1_000_000

#: Kinds of bytes: lower, upper, digit, beyond ASCII, sentence marks, other.
_KIND = np.array([1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 4 if 48 <= b <= 57 else 8 if b > 127
                  else 16 if b in b".,;:'-" else 32 for b in range(256)], np.uint64)
_REPEATED = np.uint64(64)


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, word pairs and pairs of word shapes of each row, and
    their rows.  A shape is the kinds of bytes in a word and whether the word
    repeats the one before; a repeated word gives one common pair."""
    starts, ends, row = words(data, offsets, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hash(prefix_hash(data), starts, ends)
    second = np.flatnonzero(row[1:] == row[:-1]) + 1
    repeats = np.zeros(len(starts), bool)
    repeats[second] = h[second] == h[second - 1]
    spans = np.stack([starts, ends], 1).ravel()
    shape = np.bitwise_or.reduceat(np.append(_KIND[data], np.uint64(0)), spans)[::2] | (repeats * _REPEATED)
    pair = np.where(repeats[second], np.uint64(1), mix64(h[second - 1] * np.uint64(3) + h[second]))
    shapes = mix64((shape[second - 1] << np.uint64(8)) + shape[second] + np.uint64(1 << 40))
    found = np.concatenate([mix64(h), pair, shapes])
    return (found >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([row, row[second], row[second]])


def _counter(text: str, target: str, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            is_good = batch.column(target).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_blocks(batch.column(text)):
                bucket, row = ngrams(data, offsets, bits)
                raw += np.bincount(bucket, minlength=1 << bits)
                good += np.bincount(bucket[is_good[lo:hi][row]], minlength=1 << bits)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])
    return count


def _scorer(text: str, out: str, ratio: np.ndarray, bits: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi, data, offsets in text_blocks(batch.column(text)):
                bucket, row = ngrams(data, offsets, bits)
                total[lo:hi] = np.bincount(row, weights=ratio[bucket], minlength=hi - lo)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
            yield batch.append_column(out, pa.array(total / np.maximum(n, 1)))
    return score


def best_cut(scores: np.ndarray, good: np.ndarray) -> float | None:
    """The cut with the fewest errors (good below it or bad from it on); the
    middle of the widest gap if several are as good; None if a kind is missing."""
    if good.all() or not good.any():
        return None
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum(~g[::-1])[::-1], [0]])
    low, high = np.concatenate([[s[0] - 1], s]), np.concatenate([s, [s[-1] + 1]])
    real = low < high
    at = np.flatnonzero(real & (errors == errors[real].min()))
    at = at[np.argmax((high - low)[at])]
    return float((low[at] + high[at]) / 2)


def kth_largest(df: DataFrame, value: str, k: int) -> int:
    """The k-th largest of a long column: 16 bits a pass, from counts of at most
    65,536 prefixes."""
    least, most = df.agg(F.min(value), F.max(value)).first()
    shift = max(0, (int(most - least).bit_length() - 1) // 16 * 16)
    prefix = 0
    offset = F.col(value) - F.lit(least)
    while True:
        inside = df.where(F.shiftright(offset, shift + 16) == prefix)
        counts = inside.groupBy(F.shiftright(offset, shift).alias("p")).count().collect()
        for p, n in sorted(counts, reverse=True):
            if n >= k:
                break
            k -= n
        if not shift:
            return least + p
        prefix, shift = p, shift - 16


class Resampler:
    """Fitted models; ``scores`` has a row per document, ``keep`` filters a table.

    ``docs`` needs ``doc_id`` and ``text``; ``labels`` needs ``doc_id`` and
    ``quality`` (1 good, 0 bad).  ``share`` fixes k as a share of the documents
    instead of the count on the good side of the cut.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS, sample_rows: int = SAMPLE_ROWS,
                 share: float | None = None, seed: int = 7):
        self.bits, self.seed = bits, seed
        known = (labels.where("doc_id is not null and quality is not null")
                 .groupBy("doc_id").agg((F.max("quality") == 1).alias("good")))
        sample = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "quality-sample")
        rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")  # at most sample_rows rows
        counted = (rows.select("text", "good").mapInArrow(_counter("text", "good", bits), "bucket long, raw long, good long")
                   .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow())  # a row per bucket
        raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
        raw[counted["bucket"]], target[counted["bucket"]] = counted["raw"], counted["good"]
        p_raw = (raw + 0.01) / (raw + 0.01).sum()
        self.ratio = np.log((target + PRIOR * p_raw) / (target.sum() + PRIOR)) - np.log(p_raw)
        noisy = rows.select("doc_id", "good", "text", self._noise().alias("noise"))
        scored = noisy.mapInArrow(_scorer("text", "ratio", self.ratio, bits),
                                  T.StructType([*noisy.schema.fields, T.StructField("ratio", T.DoubleType())]))
        self.scores = staged(scored.select("doc_id", "good", "ratio", self._key("ratio", "noise").alias("key")), "quality-scores")
        labelled = self.scores.where("good is not null").groupBy("doc_id").agg(F.min("ratio").alias("ratio"), F.first("good").alias("good")).toArrow()
        self.cut = best_cut(labelled["ratio"].to_numpy(), labelled["good"].to_numpy().astype(bool)) if len(labelled) else None
        n, above = self.scores.agg(F.count("*"), F.count_if(F.col("ratio") >= F.lit(self.cut))).first()
        self.k = int(share * n) if share is not None else above if self.cut is not None else n
        self.least = kth_largest(self.scores, "key", self.k) if 0 < self.k < n else None

    def _noise(self):
        """Standard Gumbel noise that depends on doc_id and the seed alone."""
        u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(self.seed)), 11) + 0.5) / F.lit(2.0 ** 53)
        return -F.log(-F.log(u))

    def _key(self, ratio: str, noise: str):
        return F.round((F.col(ratio) * EFFECTIVE_LENGTH + F.col(noise)) * KEY_UNITS).cast("long")

    def kept(self, key: str):
        """Whether a key is drawn."""
        return F.lit(self.k > 0) if self.least is None else F.col(key) >= self.least

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that the draw keeps, with their columns."""
        noise, ratio, key = (fresh(docs, x) for x in ("noise", "ratio", "key"))
        noisy = docs.withColumn(noise, self._noise())
        scored = noisy.mapInArrow(_scorer("text", ratio, self.ratio, self.bits),
                                  T.StructType([*noisy.schema.fields, T.StructField(ratio, T.DoubleType())]))
        return scored.withColumn(key, self._key(ratio, noise)).where(self.kept(key)).select(docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, log_ratio (per n-gram), key (Gumbel key in nats), keep."""
    fitted = Resampler(docs, labels, **options)
    return fitted.scores.select("doc_id", F.col("ratio").alias("log_ratio"), (F.col("key") / KEY_UNITS).alias("key"),
                                fitted.kept("key").alias("keep"))
