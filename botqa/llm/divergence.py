"""Source divergence audit by iceberg prefix refinement.

How a source's use of words departs from its language's and from the other
sources'.  The vocabulary of a language is its terms in at least ``MIN_DOCS``
documents.  It is found without counting every term: level by level, the byte
prefixes of the terms are extended (to 4, 8, 16, ... bytes); a prefix whose number
of distinct documents falls below the threshold is discarded with all terms
under it, since no term is in more documents than its prefix.  A level counts the
terms that end within it, and the prefixes of the longer ones; the levels end when
no prefix is left.  A document is one row of one task, so each task counts
documents by itself and Spark adds up.

Surviving prefixes travel as a bitmap of bounded size (``HashFilter``); a prefix
that passes by chance is counted and then discarded, so results are exact at any
size.  Distances between sources are added up over blocks of terms: each block is
a dense matrix of sources by at most ``CELLS`` / sources terms, and gives one
partial sum per pair of sources.

Edges: null text, lang and source count as ''; repeated rows are documents of
their own; a group without terms has every kept term with count 0; without kept
terms the distances are 0; an empty table gives an empty result; other columns
are not read.
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

MIN_DOCS, SMOOTHING, FIRST_LEVEL, TOP_TERMS = 30, 5, 4, 50
#: Cells of the matrix that a task compares sources in.
CELLS = 1 << 20
BLOCK_BYTES = 4 << 20

_INSIDE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _level(low: int, high: int, alive: HashFilter | None):
    """Counts of one block of texts: terms of ``low`` + 1 to ``high`` bytes by
    (lang, source), and prefixes of ``high`` bytes of the longer ones by lang
    (source and term null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
            names = list(dict.fromkeys((g["lang"], g["source"]) for g in groups.to_pylist()))
            number = {g: i for i, g in enumerate(names)}
            group = np.array([number[g["lang"], g["source"]] for g in groups.to_pylist()], np.int64)
            langs = list(dict.fromkeys(lang for lang, _ in names))
            lang_of = np.array([langs.index(lang) for lang, _ in names], np.int64)
            salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)
            for lo, hi, data, offsets in text_blocks(batch.column("text"), BLOCK_BYTES):
                data = _LOWER[data]
                starts, ends, row = words(data, offsets, _INSIDE)
                if not len(row):
                    continue
                code, terms = coded(data, starts, ends, _INSIDE)
                flat, at = binary_parts(terms)
                size, hashed = np.diff(at), prefix_hash(flat)
                prefix = lambda n: span_hash(hashed, at[:-1], np.minimum(at[:-1] + n, at[1:]))
                use = size > low
                some = use[code]
                pair, count = np.unique(row[some] * len(terms) + code[some], return_counts=True)  # a document's distinct terms
                doc, code = np.divmod(pair, len(terms))
                home = group[lo:hi][doc]
                if low:
                    passes = alive.has(mix64(prefix(low)[code] + salt[lang_of[home]]))
                    doc, code, home, count = doc[passes], code[passes], home[passes], count[passes]
                ended = size[code] <= high
                key, back = np.unique(home[ended] * len(terms) + code[ended], return_inverse=True)
                where, which = np.divmod(key, len(terms))
                yield _rows(lang_of[where], langs, where, names, terms.take(pa.array(which)), np.zeros(len(key), np.uint64),
                            np.bincount(back, minlength=len(key)), np.bincount(back, weights=count[ended], minlength=len(key)).astype(np.int64))
                longer = ~ended
                if longer.any():
                    begins = mix64(prefix(high)[code[longer]] + salt[lang_of[home[longer]]])
                    value, place = np.unique(begins, return_inverse=True)
                    once = np.unique(doc[longer] * len(value) + place) % len(value)  # a prefix counts once in a document
                    lang = np.zeros(len(value), np.int64)
                    lang[place] = lang_of[home[longer]]
                    docs = np.bincount(once, minlength=len(value))
                    yield _rows(lang, langs, None, names, pa.nulls(len(value), pa.large_binary()), value, docs, np.zeros(len(value), np.int64))
    return run


def _rows(lang, langs, where, names, terms, h, docs, n) -> pa.RecordBatch:
    source = pa.nulls(len(lang), pa.string()) if where is None else pa.array([s for _, s in names], pa.string()).take(pa.array(where))
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()).take(pa.array(lang)), source, terms.cast(pa.large_string()).cast(pa.string()), pa.array(h.view(np.int64)),
         pa.array(docs.astype(np.int64)), pa.array(n)], ["lang", "source", "term", "h", "docs", "n"])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n (occurrences there), lang_n, for the terms in at
    least ``min_docs`` documents of the lang and the sources that use them."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    ended, low, high, alive = [], 0, FIRST_LEVEL, None
    while alive is None or alive.count:
        found = texts.mapInArrow(_level(low, high, alive), "lang string, source string, term string, h long, docs long, n long")
        found = staged(found.groupBy("lang", "source", "term", "h").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "terms")
        ended.append(found.where("term is not null").drop("h"))
        alive = HashFilter(found.where(F.col("term").isNull() & (F.col("docs") >= min_docs)))
        low, high = high, 2 * high
    counts = ended[0]
    for more in ended[1:]:
        counts = counts.unionByName(more)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    return counts.drop("docs").join(kept.drop("docs"), ["lang", "term"])


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 5) / (size + 5 terms)) in two long divisions, so
    that no product passes 64 bits below 10**13 occurrences."""
    over, under = (count + SMOOTHING) * 100_000, size + SMOOTHING * terms
    whole, rest = F.call_function("div", over, under), over % under
    return 1 + whole * 10_000 + F.call_function("div", rest * 10_000, under)


def _distances(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums of |p - q| over a block of terms for all pairs of sources.  Rows
    without a term hold the share of the terms that a source doesn't use."""
    source = table["source"].combine_chunks().dictionary_encode()
    s, p = source.indices.to_numpy(zero_copy_only=False), table["p"].to_numpy()
    term = pc.fill_null(table["term"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    base = np.zeros(len(source.dictionary), np.int64)
    base[s[term < 0]] = p[term < 0]
    cells = np.repeat(base[:, None], term.max(initial=-1) + 1, axis=1)
    cells[s[term >= 0], term[term >= 0]] = p[term >= 0]
    n = len(base)
    value = np.array([np.abs(cells - cells[i]).sum(axis=1) for i in range(n)], np.int64).reshape(n, n)
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    names = source.dictionary
    return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value[a, b])],
                    names=["lang", "source", "item", "value"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, cells: int = CELLS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair``: distance to each other source of the lang;
    ``term``: the ``top`` terms that the source uses more than its lang), item,
    value, rank."""
    kept = staged(kept_terms(docs, min_docs), "kept-terms")
    per_lang = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_size"))
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = (groups.join(sizes, ["lang", "source"], "left").join(per_lang, "lang", "left")
              .na.fill(0, ["size", "terms", "lang_size"]))
    width = groups.groupBy("lang").agg((F.floor(F.count("*") * F.max("terms") / cells) + 1).alias("blocks"))
    groups = staged(groups.join(width, "lang"), "groups")
    used = kept.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("size"), F.col("terms"))
    blocks = used.select("lang", F.expr("pmod(xxhash64(term), blocks)").alias("block"), "source", "term", p.alias("p"))
    base = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
                         F.lit(None).cast("string").alias("term"),
                         F.when(F.col("terms") > 0, share(F.lit(0), F.col("size"), F.col("terms"))).otherwise(0).alias("p"))
    pairs = (blocks.unionByName(base).groupBy("lang", "block").applyInArrow(_distances, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair")))
    q = share(F.col("lang_n"), F.col("lang_size"), F.col("terms"))
    over = used.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"), F.lit("term").alias("part")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)).select(
        "lang", "source", "part", "item", "value", "rank")
