"""Toxic passages by maximum-scoring segment search.

Every token has a score: the log-odds of its features (the word and its first 4,
6 and 8 bytes) between toxic and other documents, with an informative Dirichlet
prior from the whole corpus, shrunk to the bound nearer zero of its confidence
interval, less a drift that makes ordinary text score negative.  A linear-time
scan finds all maximal scoring segments of a document.  Scores follow an extreme
value law: a segment of score S in a text of m tokens is expected m exp(-lambda S)
times by chance, with lambda from the score distribution of other documents;
segments expected less than ``MAX_EXPECTED`` times are significant.  A document's
evidence is the sum of lambda S - ln m over them, and a logistic curve fitted to
the labels maps it to a score from 0 to 1.  The curve is cross-fitted: it sees the
evidence that a text has by a lexicon learnt without the text's fold, which is what
a new document has, and not that of the rows that chose the lexicon.

Counts by feature are Spark aggregates; all features whose score exceeds the drift
travel to the tasks as the lexicon.  Labels are used on a bounded sample, one
document per distinct text, and so the lexicon holds words of at most
``SAMPLE_ROWS`` texts, however many documents there are.

Edges: null or empty text has no tokens and no evidence; null labels and null ids
are not learned from; without labels of both kinds every score is the share of
toxic labels (0 without any); repeated rows stay rows; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, prefix_hash, span_hash, staged, text_blocks, words

#: Most labelled rows that the lexicon and the curve are fitted on.
SAMPLE_ROWS = 20_000
#: Pseudo-counts of the corpus distribution as a share of all counts, width of the confidence interval, cost of a token.
#: Chosen, with the prefixes, by cross-validation among learning rows (remainder not 2) alone.
PRIOR, WIDTH, DRIFT = 0.1, 1.3, 0.03
MAX_EXPECTED = 1.0
PREFIXES = (4, 6, 8)
#: Parts of the sample, by the text's hash, that the curve is cross-fitted on.
FOLDS = 4

_TOKEN = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b == 39 or b > 127 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_TABLE_BITS = 22


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(starts, ends, row) of each token and its feature hashes: the word, then
    each prefix (0 where the word is shorter)."""
    data = _LOWER[data]
    starts, ends, row = words(data, offsets, _TOKEN)
    p = prefix_hash(data)
    found = [span_hash(p, starts, ends)]
    for n in PREFIXES:
        h = mix64(span_hash(p, starts, np.minimum(starts + n, ends)) + np.uint64(n))
        found.append(np.where(ends - starts >= n, h, np.uint64(0)))
    return starts, ends, row, found


def _presence(row: np.ndarray, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs."""
    r, f = np.tile(row, len(found)), np.concatenate(found)
    r, f = r[f > 0], f[f > 0]
    order = np.lexsort((f, r))
    r, f = r[order], f[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
    return r[new], f[new]


class Lexicon:
    """Sorted feature hashes with their scores."""

    def __init__(self, feature: np.ndarray, score: np.ndarray):
        order = np.argsort(feature)
        self.feature, self.score = feature[order], score[order]

    def find(self, h: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are in the lexicon, and their places in it."""
        at = np.flatnonzero(maybe[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.feature, h[at]), len(self.feature) - 1)
        hit = self.feature[place] == h[at]
        return at[hit], place[hit]

    def maybe(self) -> np.ndarray:
        """Whether any feature has the first bits of a hash."""
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(self.feature >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        return table

    def __len__(self) -> int:
        return len(self.feature)


def maximal_segments(left: list[float], right: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (first, last positive token), given the total
    score before and after each positive token: one pass with a stack, in which
    each token enters and leaves once."""
    stack: list[list] = []  # [left, right, first, last]
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        now = [a, b, i, i]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= now[0]:
                j -= 1
            if j < 0 or stack[j][1] >= now[1]:
                stack.append(now)
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(x[2], x[3]) for x in stack]


def _scorer(text: str, lexicon: Lexicon, lam: float, drift: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = lexicon.maybe()
        for batch in batches:
            tokens, evidence = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            passages: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, hi, data, offsets in text_blocks(batch.column(text)):
                starts, ends, row, found = features(data, offsets)
                n = np.bincount(row, minlength=hi - lo)
                tokens[lo:hi] = n
                if not len(row) or not len(lexicon):
                    continue
                gain = np.zeros(len(row))
                for h in found:
                    at, place = lexicon.find(h, maybe)
                    gain[at] = np.maximum(gain[at], lexicon.score[place])
                again = np.flatnonzero((found[0][1:] == found[0][:-1]) & (row[1:] == row[:-1])) + 1
                gain[again] = 0  # a word said over and over counts once, as in the counts by document
                total = np.cumsum(gain - drift)
                positive = np.flatnonzero(gain > drift)
                if not len(positive):  # ordinary text alone
                    continue
                cut = np.flatnonzero(np.r_[True, row[positive][1:] != row[positive][:-1]])
                for a, b in zip(cut, [*cut[1:], len(positive)], strict=True):
                    some = positive[a:b]
                    left, right = total[some] - gain[some] + drift, total[some]
                    r = int(row[some[0]])
                    expected = np.log(max(n[r], 1))
                    raw = data[offsets[r]:offsets[r + 1]]
                    for i, j in maximal_segments(left.tolist(), right.tolist()):
                        score = float(right[j] - left[i])
                        if lam * score - expected > -np.log(MAX_EXPECTED):
                            evidence[lo + r] += lam * score - expected
                            first, last = starts[some[i]] - offsets[r], ends[some[j]] - offsets[r]
                            chars = np.cumsum((raw[:last] & 0xC0) != 0x80)
                            begin = int(chars[first - 1]) if first else 0
                            passages[lo + r].append({"start": begin, "end": int(chars[-1]), "score": score,
                                                     "expected": float(np.exp(expected - lam * score))})
            out = batch.drop_columns([text])
            for name, column in (("tokens", pa.array(tokens)), ("evidence", pa.array(evidence)), ("passages", pa.array(passages, _PASSAGES_ARROW))):
                out = out.append_column(name, column)
            yield out
    return run


_PASSAGES_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
_PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                      T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


#: toxic and other texts with a feature, by fold
_COUNTS = [f"{kind}{k}" for k in range(FOLDS) for kind in ("toxic", "other")]


def _label_counts(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            fold = batch.column("fold").to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(text)):
                _, _, row, found = features(data, offsets)
                r, f = _presence(row, found)
                feature, at = np.unique(f, return_inverse=True)
                cell = at * (2 * FOLDS) + 2 * fold[lo:hi][r] + ~toxic[lo:hi][r]
                n = np.bincount(cell, minlength=len(feature) * 2 * FOLDS).reshape(len(feature), 2 * FOLDS)
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), *map(pa.array, n.T)], ["feature", *_COUNTS])
    return run


def _corpus_counts(text: str, lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = lexicon.maybe()
        total, count = 0, np.zeros(len(lexicon), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(text)):
                _, _, row, found = features(data, offsets)
                total += sum(int((h > 0).sum()) for h in found)
                pairs = [lexicon.find(h, maybe) for h in found]
                r, f = np.concatenate([row[at] for at, _ in pairs]), np.concatenate([p for _, p in pairs])
                seen = np.unique(r * len(lexicon) + f) % len(lexicon)
                count += np.bincount(seen, minlength=len(lexicon))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[lexicon.feature[some].view(np.int64), 0]), pa.array(np.r_[count[some], total])],
                                         ["feature", "n"])
    return run


def log_odds(toxic: np.ndarray, other: np.ndarray, prior: np.ndarray, all_toxic: float, all_other: float, strength: float,
             width: float) -> np.ndarray:
    """Log-odds ratio with a Dirichlet prior, less ``width`` standard deviations."""
    a, b = toxic + prior, other + prior
    delta = np.log(a / (all_toxic + strength - a)) - np.log(b / (all_other + strength - b))
    return delta - width * np.sqrt(1 / a + 1 / b)


def _decay(scores: np.ndarray, chance: np.ndarray, drift: float) -> float:
    """lambda > 0 with sum of p exp(lambda s) = 1 over the scores of other documents."""
    rest = max(0.0, 1 - float(chance.sum()))
    lo, hi = 1e-6, 1.0
    value = lambda x: rest * np.exp(-x * drift) + float((chance * np.exp(np.minimum(x * (scores - drift), 700))).sum())
    while value(hi) < 1 and hi < 1e3:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return lo


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (at least 0) of a logistic curve, by Newton steps, with
    targets smoothed by one example of each kind."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([np.log((n1 + 1) / (n0 + 1)), 0.0])
    z = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - t) + 1e-3 * np.array([0, w[1]]))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _total(get, kind: str, without: int | None):
    """The sum of a kind's counts over the folds, but for one."""
    return sum(get(f"{kind}{k}") for k in range(FOLDS) if k != without)


def _first_bound(toxic: Column, other: Column, all_toxic: float, all_other: float) -> Column:
    """Lower bound of the log-odds with the sample's own distribution as prior."""
    if not all_toxic or not all_other:
        return F.lit(0.0)
    strength = PRIOR * (all_toxic + all_other)
    prior = F.lit(strength) * (toxic + other) / F.lit(all_toxic + all_other)
    a, b = toxic + prior, other + prior
    bound = F.log(a / (F.lit(all_toxic + strength) - a)) - F.log(b / (F.lit(all_other + strength) - b)) - WIDTH * F.sqrt(1 / a + 1 / b)
    return F.when(toxic > 0, bound).otherwise(0.0)


def _fitted(hashes: np.ndarray, toxic: np.ndarray, other: np.ndarray, all_toxic: float, all_other: float,
            share: np.ndarray) -> tuple[Lexicon, float]:
    """Lexicon and lambda, given each feature's share of the corpus."""
    if not all_toxic or not all_other:
        return Lexicon(hashes[:0], np.zeros(0)), 1.0
    strength = PRIOR * (all_toxic + all_other)
    prior = np.maximum(strength * share, 1e-9)
    score = log_odds(toxic, other, prior, all_toxic, all_other, strength, WIDTH)
    keep = (score > DRIFT) & (toxic > 0)
    chance = ((other + prior) / (all_other + strength))[keep]
    return Lexicon(hashes[keep], score[keep]), _decay(score[keep], chance, DRIFT) if keep.any() else 1.0


class ToxicityModel:
    """Lexicon, lambda and curve, fitted on ``labels`` (``doc_id``, ``toxic``) of
    the rows that ``learn`` (a condition on doc_id) admits."""

    def __init__(self, docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample_rows: int = SAMPLE_ROWS):
        known = labels.where("doc_id is not null and toxic is not null")
        known = (known if learn is None else known.where(learn)).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
        sample = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "toxic-sample")
        texts = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")  # at most sample_rows rows
        texts = staged(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
                       .withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("long")).drop("h"), "toxic-texts")
        counts = staged(texts.mapInArrow(_label_counts("text"), "feature long, " + ", ".join(f"{c} long" for c in _COUNTS))
                        .groupBy("feature").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "toxic-counts")
        n1, n0 = (int(x or 0) for x in texts.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first())
        self.lexicon, self.decay, self.curve = Lexicon(np.zeros(0, np.uint64), np.zeros(0)), 1.0, (-30.0, 0.0)
        if not n1 or not n0:
            self.curve = (30.0, 0.0) if n1 else self.curve
            return
        # first choice on the sample's own prior, for the whole sample and for it without each fold
        sums = {c: float(x or 0) for c, x in zip(_COUNTS, counts.agg(*[F.sum(c) for c in _COUNTS]).first(), strict=True)}
        without = [None, *range(FOLDS)]
        bounds = [_first_bound(_total(F.col, "toxic", k), _total(F.col, "other", k), _total(sums.get, "toxic", k), _total(sums.get, "other", k))
                  for k in without]
        first = counts.where(F.greatest(*bounds) > DRIFT).toPandas()
        if not len(first):
            self.curve = (float(np.log(n1 / n0)), 0.0)
            return
        # then the prior from all documents
        hashes = first.feature.to_numpy(np.int64).view(np.uint64)
        chosen = Lexicon(hashes, np.zeros(len(first)))
        seen = docs.select("text").mapInArrow(_corpus_counts("text", chosen), "feature long, n long").groupBy("feature").agg(F.sum("n")).collect()
        seen = dict(map(tuple, seen))
        total = float(seen.pop(0))
        n = np.array([seen.get(int(f), 0) for f in first.feature], float)
        models = [_fitted(hashes, *[_total(first.get, kind, k).to_numpy(float) for kind in ("toxic", "other")],
                          *[_total(sums.get, kind, k) for kind in ("toxic", "other")], n / total) for k in without]
        self.lexicon, self.decay = models[0]
        found = [self._scan(texts.where(F.col("fold") == k), *models[k + 1]).select("toxic", "evidence").toPandas()  # a row per sampled text
                 for k in range(FOLDS)]
        evidence, toxic = (np.concatenate([x[c].to_numpy(float) for x in found]) for c in ("evidence", "toxic"))
        self.curve = fit_logistic(np.log1p(evidence), toxic)

    @staticmethod
    def _scan(docs: DataFrame, lexicon: Lexicon, decay: float) -> DataFrame:
        fields = [f for f in docs.schema.fields if f.name != "text"]
        schema = T.StructType([*fields, T.StructField("tokens", T.LongType()), T.StructField("evidence", T.DoubleType()),
                               T.StructField("passages", _PASSAGES)])
        return docs.mapInArrow(_scorer("text", lexicon, decay, DRIFT), schema)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, tokens, evidence, passages (code points, end exclusive) and score of each document."""
        x = F.lit(self.curve[0]) + F.lit(self.curve[1]) * F.log1p("evidence")
        return self._scan(docs.select("doc_id", "text"), self.lexicon, self.decay).withColumn("score", 1 / (1 + F.exp(-x)))
