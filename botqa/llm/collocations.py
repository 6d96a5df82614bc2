"""Phrase collocations by SON partitioning.

Documents are dealt into shards.  Each shard is mined completely, level by level:
words, then pairs of its frequent words, then triples whose two pairs are frequent
in it.  A phrase is frequent in a shard if it occurs there ceil(``MIN_COUNT`` x the
shard's share of the lang's words) times: a phrase with ``MIN_COUNT`` occurrences
in all reaches that in one shard at least.  The union of the shards' frequent
phrases is then counted exactly over all texts, by the phrases themselves.

A shard is a set of rows and not a task: its counts are Spark aggregates of what
the tasks counted block by block.  Between the passes the frequent phrases travel
as bitmaps of bounded size (``HashFilter``); one that passes by chance is counted
and then discarded, so results are exact at any size.  Few shards keep the local
support above 1, which is what prunes; any number gives the same result.

Edges: null text counts as empty, null lang as ``und``; repeated rows all count;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HashFilter, binary_parts, coded, mix64, prefix_hash, span_hash, staged, text_blocks, words

MIN_COUNT, INSIDE_PERCENT, TOP, SHARDS = 10, 50, 2000, 4
#: Copies of the counted words and pairs in joins, so that a frequent one's phrases are spread.
SALTS = 8
#: Shards of langs whose local support travels to the tasks.
SUPPORT_ROWS = 10_000
BLOCK_BYTES = 1 << 20

_BREAK = np.array([chr(b) in ".,;:!?\n\x0b\x0c\r" for b in range(256)])
_INSIDE = np.array([not _BREAK[b] and chr(b) not in " \t" for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class _Block:
    """Words of a block of texts: number of each word in ``vocabulary``, its row,
    whether it and the next one stand in one piece, and the words' hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = _LOWER[data]
        starts, ends, self.row = words(data, offsets, _INSIDE)
        self.code, self.vocabulary = coded(data, starts, ends, _INSIDE)
        breaks = np.cumsum(_BREAK[data])
        self.joined = np.zeros(len(starts), bool)
        if len(starts):
            self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
        flat, at = binary_parts(self.vocabulary)
        self.hash = span_hash(prefix_hash(flat), at[:-1], at[1:])

    def phrases(self, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pair and the triple that begin at each word (of no use
        where the words are not in one piece); ``salt``: hash of each word's lang."""
        h = self.hash[self.code]
        second, third = np.roll(h, -1), np.roll(h, -2)
        pair = mix64(h * np.uint64(0x9E3779B97F4A7C15) + mix64(second + np.uint64(1)) + salt)
        return pair, mix64(pair + mix64(third + np.uint64(2)))


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Blocks of texts: words, names of the langs, lang number and shard of each
    word, hashes of the langs."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        names = lang.dictionary.to_pylist()
        lang, shard = lang.indices.to_numpy().astype(np.int64), batch.column("shard").to_numpy().astype(np.int64)
        for lo, hi, data, offsets in text_blocks(batch.column("text"), BLOCK_BYTES):
            block = _Block(data, offsets)
            if len(block.row):
                some, number = np.unique(lang[lo:hi], return_inverse=True)
                salt = np.array([xxhash.xxh64_intdigest(names[i].encode()) for i in some], np.uint64)
                yield block, [names[i] for i in some], number[block.row], shard[lo:hi][block.row], salt


def _masks(shards: int) -> np.ndarray:
    """What turns a phrase's hash into its hash in a shard, by exclusive or."""
    return mix64(np.arange(1, shards + 1, dtype=np.uint64))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of each block by lang and shard."""
    for block, names, lang, shard, salt in _blocks(batches):
        n, kinds = len(block.vocabulary), int(shard.max()) + 1
        key, count = np.unique((lang * kinds + shard) * n + block.code, return_counts=True)
        cell, code = np.divmod(key, n)
        lang, shard = np.divmod(cell, kinds)
        h = mix64(block.hash[code] + salt[lang])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()).take(pa.array(lang)), pa.array(shard.astype(np.int32)),
             block.vocabulary.take(pa.array(code)).cast(pa.large_string()).cast(pa.string()), pa.array(h.view(np.int64)), pa.array(count)],
            ["lang", "shard", "word", "h", "n"])


def _mined(size: int, frequent: HashFilter, shards: int, support: dict, min_count: int):
    """Counts by shard of pairs of frequent words, or of triples of frequent pairs.
    ``cell`` is the shard and its local support in one number; a lang that
    ``support`` leaves out has the lowest one, which only prunes less."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(shards)
        for block, names, lang, shard, salt in _blocks(batches):
            pair, triple = block.phrases(salt[lang])
            if size == 2:
                good = frequent.has(mix64(block.hash[block.code] + salt[lang]) ^ masks[shard])
                use, value = block.joined & good & np.roll(good, -1), pair
            else:
                good = block.joined & frequent.has(pair ^ masks[shard])
                use, value = good & np.roll(good, -1), triple
            at = np.flatnonzero(use)
            if not len(at):
                continue
            cell = lang[at] * shards + shard[at]
            order = np.argsort(cell, kind="stable")
            cut = np.flatnonzero(np.diff(cell[order], prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
                some = at[order[a:b]]
                h, count = np.unique(value[some], return_counts=True)
                s = int(shard[some[0]])
                cell_of = pa.scalar(s * (min_count + 1) + support.get((names[lang[some[0]]], s), 1), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.repeat(cell_of, len(h)), pa.array(count.astype(np.int32))],
                                                 ["h", "cell", "n"])
    return run


def _exact(pairs: HashFilter, triples: HashFilter):
    """Counts of the candidates, by the phrases themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names, lang, _, salt in _blocks(batches):
            pair, triple = block.phrases(salt[lang])
            n = len(block.vocabulary)
            at = np.flatnonzero(block.joined & pairs.has(pair))
            if not len(at):
                continue
            key, number, count = np.unique((lang[at] * n + block.code[at]) * n + block.code[at + 1], return_inverse=True, return_counts=True)
            first, second = np.divmod(key, n)
            where, first = np.divmod(first, n)
            yield _phrases(block, names, where, (first, second), count)
            pair_of = np.full(len(block.row), -1)
            pair_of[at] = number
            at = np.flatnonzero((pair_of >= 0) & (np.roll(pair_of, -1) >= 0) & block.joined & np.roll(block.joined, -1) & triples.has(triple))
            if len(at):
                key, count = np.unique(pair_of[at] * n + block.code[at + 2], return_counts=True)
                head, third = np.divmod(key, n)
                yield _phrases(block, names, where[head], (first[head], second[head], third), count)
    return run


def _phrases(block: _Block, names: list[str], lang: np.ndarray, codes: tuple, count: np.ndarray) -> pa.RecordBatch:
    parts = [block.vocabulary.take(pa.array(c)).cast(pa.large_string()) for c in codes]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(lang)), pa.array(np.full(len(lang), len(codes), np.int32)), phrase,
                                       pa.array(count)], ["lang", "size", "phrase", "n"])


class Phrases:
    """The phrases of 2 and 3 words with ``min_count`` occurrences in a lang
    (``counts``: lang, size, phrase, a) and the words they are made of
    (``words``: lang, word, n), over ``totals`` (lang, n)."""

    def __init__(self, docs: DataFrame, min_count: int = MIN_COUNT, shards: int = SHARDS):
        texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
        local = texts.mapInArrow(_word_counts, "lang string, shard int, word string, h long, n long")
        local = staged(local.groupBy("lang", "shard", "word", "h").agg(F.sum("n").alias("n")), "words")
        sizes = staged(local.groupBy("lang", "shard").agg(F.sum("n").alias("size")), "shard-sizes")  # a row per lang and shard
        self.totals = sizes.groupBy("lang").agg(F.sum("size").alias("n"))
        supports = sizes.join(self.totals, "lang").select("lang", "shard", "size", F.expr(f"cast(div({min_count} * size + n - 1, n) as int)").alias("support"))
        # the largest SUPPORT_ROWS; a shard of any other lang is mined down to one occurrence
        support = {(r["lang"], r["shard"]): r["support"] for r in supports.orderBy(F.desc("size"), "lang", "shard").limit(SUPPORT_ROWS).collect()}
        masks = F.array(*(F.lit(int(m)) for m in _masks(shards).view(np.int64)))

        def hashes(shard: Column) -> list[Column]:
            return [F.col("h"), F.col("h").bitwiseXOR(F.element_at(masks, shard + 1)).alias("in_shard")]

        self.words = local.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        words = local.join(supports, ["lang", "shard"]).where("n >= support").select(*hashes(F.col("shard")))
        found, below = [], HashFilter(words, "in_shard")
        for size in (2, 3):
            mined = texts.mapInArrow(_mined(size, below, shards, support, min_count), "h long, cell int, n int")
            mined = mined.groupBy("h", "cell").agg(F.sum("n").alias("n")).where(F.col("n") >= F.col("cell") % (min_count + 1))
            mined = staged(mined.select(*hashes(F.expr(f"div(cell, {min_count + 1})").cast("int"))), "frequent")
            found.append(HashFilter(mined.select("h").distinct()))
            below = HashFilter(mined, "in_shard") if size == 2 else below
        exact = texts.mapInArrow(_exact(*found), "lang string, size int, phrase string, n long")
        self.counts = staged(exact.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count), "phrases")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's ``top`` collocations."""
    found = Phrases(docs, min_count, shards)

    def salted(table: DataFrame) -> DataFrame:
        return staged(table, "counted").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    salt = F.expr(f"cast(pmod(xxhash64(phrase), {SALTS}) as int)").alias("salt")
    words = salted(found.words)
    pairs = salted(found.counts.where("size = 2").select("lang", F.col("phrase").alias("part"), F.col("a").alias("n")))

    def with_word(rows: DataFrame, at: int, name: str) -> DataFrame:
        rows = rows.select("*", F.element_at("w", at).alias("word"), salt)
        return rows.join(words.withColumnRenamed("n", name), ["lang", "word", "salt"]).drop("word", "salt")

    def with_pair(rows: DataFrame, at: int, part: str, name: str) -> DataFrame:
        rows = rows.select("*", F.concat_ws(" ", F.slice("w", at, 2)).alias(part), salt)
        return rows.join(pairs.select("lang", F.col("part").alias(part), "salt", F.col("n").alias(name)), ["lang", part, "salt"]).drop("salt")

    counts = found.counts.withColumn("w", F.split("phrase", " "))
    ends = staged(with_word(with_word(counts, 1, "f_first"), -1, "f_last"), "phrase-ends")
    triples = staged(with_pair(with_pair(ends.where("size = 3"), 1, "head", "f_head"), 2, "tail", "f_tail"), "triples")
    longest = (triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    two = (ends.where("size = 2").join(longest, ["lang", "phrase"], "left")
           .where(F.expr(f"longer is null or 100 * longer < {INSIDE_PERCENT} * a"))
           .select("lang", "phrase", "a", F.col("f_first").alias("l"), F.col("f_last").alias("r"))
           .withColumn("score", _score("a", "l", "r")))
    cuts = triples.withColumn("s1", _score("a", "f_first", "f_tail")).withColumn("s2", _score("a", "f_head", "f_last"))
    early = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", "phrase", "a", F.when(early, F.col("f_first")).otherwise(F.col("f_head")).alias("l"),
                        F.when(early, F.col("f_tail")).otherwise(F.col("f_last")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _score(a: str, left: str, right: str) -> Column:
    """floor(10**6 a a / (l r)), in decimals of 38 digits."""
    return F.expr(f"cast(div(cast(1000000 as decimal(38, 0)) * (cast({a} as decimal(19, 0)) * cast({a} as decimal(19, 0))), "
                  f"cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0))) as long)")
