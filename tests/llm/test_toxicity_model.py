"""The toxicity model from counts to score, against plain Python on strings."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from botqa.llm import toxicity as t
from botqa.llm.common import BLOCK_BYTES


def _features(text):
    """Of each word, in order: the word and its prefixes."""
    words = re.findall(rb"[0-9a-z'\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return [[("word", w), *[(n, w[:n]) for n in t.PREFIXES if len(w) >= n]] for w in words]


def _learn(texts, corpus):
    """Score by feature and lambda, from (text, toxic) and the corpus."""
    toxic, other, seen, total = {}, {}, {}, 0
    for text, y in texts:
        for f in {f for word in _features(text) for f in word}:
            side = toxic if y else other
            side[f] = side.get(f, 0) + 1
    for text in corpus:
        words = _features(text)
        total += sum(map(len, words))
        for f in {f for word in words for f in word}:
            seen[f] = seen.get(f, 0) + 1
    n1, n0 = sum(toxic.values()), sum(other.values())
    if not n1 or not n0:
        return {}, 1.0
    strength, score, chance = t.PRIOR * (n1 + n0), {}, {}
    for f, count in toxic.items():
        def bound(prior, count=count, f=f):
            a, b = count + prior, other.get(f, 0) + prior
            return math.log(a / (n1 + strength - a)) - math.log(b / (n0 + strength - b)) - t.WIDTH * math.sqrt(1 / a + 1 / b)
        prior = strength * seen[f] / total
        if bound(prior) > t.DRIFT and bound(strength * (count + other.get(f, 0)) / (n1 + n0)) > t.DRIFT:
            score[f], chance[f] = bound(prior), (other.get(f, 0) + prior) / (n0 + strength)
    if not score:
        return {}, 1.0
    lo, hi = 1e-6, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        moment = max(0.0, 1 - sum(chance.values())) * math.exp(-mid * t.DRIFT) + sum(
            chance[f] * math.exp(min(mid * (s - t.DRIFT), 600)) for f, s in score.items())
        lo, hi = (mid, hi) if moment < 1 else (lo, mid)
    return score, lo


def _evidence(text, score, lam):
    words = _features(text)
    gains = [max([score.get(f, 0) for f in w]) if i == 0 or w[0] != words[i - 1][0] else 0 for i, w in enumerate(words)]
    total = np.concatenate([[0], np.cumsum([g - t.DRIFT for g in gains])])

    def best(lo, hi):
        found = [(total[j + 1] - total[i], i, j) for i in range(lo, hi) for j in range(i, hi)]
        top = max(found, default=(0, 0, 0))
        return [top[0], *best(lo, top[1]), *best(top[2] + 1, hi)] if top[0] > 1e-12 else []
    return sum(max(0.0, lam * s - math.log(len(words))) for s in best(0, len(words)))


def _model(labelled, corpus):
    """(score by feature, lambda, intercept, slope)."""
    distinct = {}
    for text, y in labelled:
        distinct[text] = max(y, distinct.get(text, 0))
    rows = list(distinct.items())
    signed = [xxhash.xxh64_intdigest(x.encode(), 42) for x, _ in rows]
    fold = [(h - (1 << 64) if h >> 63 else h) % t.FOLDS for h in signed]
    evidence = []
    for (text, _), k in zip(rows, fold, strict=True):
        evidence.append(_evidence(text, *_learn([r for r, f in zip(rows, fold, strict=True) if f != k], corpus)))
    return *_learn(rows, corpus), np.log1p(evidence), np.array([y for _, y in rows], float)


def _corpus(rng, n):
    plain, rude = [f"w{i}ord" for i in range(40)], ["idiot", "trash", "réeuxvi", "réeuxan", "moronic", "moronically"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(1, 25))]
        toxic = rng.random() < 0.35
        for _ in range(rng.randint(1, 4) if toxic else rng.random() < 0.05):
            words.insert(rng.randint(0, len(words)), rng.choice(rude))
        out.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return [*out, (n, out[0][1], 0), (n + 1, "", 0), (n + 2, "idiot idiot idiot", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_model_equals_plain_python(spark, seed):
    rows = _corpus(random.Random(seed), 90)
    learn = [(text, y) for i, text, y in rows if i % 3]
    docs = spark.createDataFrame([(i, text) for i, text, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = t.ToxicityModel(docs, labels)
    score, lam, x, y = _model(learn, [text for _, text, _ in rows])
    assert score and sorted(model.lexicon.score) == pytest.approx(sorted(score.values()))
    assert model.decay == pytest.approx(lam)
    # the curve: no slope of its penalised likelihood is left, so it is the one best curve
    a, b = model.curve
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    rest = 1 / (1 + np.exp(-(a + b * x))) - target
    assert b > 0 and abs(rest.sum()) < 1e-5 and abs((rest * x).sum() + 1e-3 * b) < 1e-5
    got = {r["doc_id"]: r for r in model.score(docs).collect()}
    for i, text, _ in rows:
        evidence = _evidence(text, score, lam)
        assert got[i]["evidence"] == pytest.approx(evidence)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(evidence)))))


def test_labels_of_one_fold(spark):
    """A kind that only one text shows leaves nothing to cross-fit: scores are shares."""
    docs = spark.createDataFrame([(1, "idiot trash"), (2, "plain words"), (3, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = [r["score"] for r in t.ToxicityModel(docs, labels).score(docs).collect()]
    assert len(set(got)) == 1 and 0 < got[0] < 1


def test_block_of_ordinary_text(spark):
    """Blocks, and whole tables, in which no word is in the lexicon."""
    rows = _corpus(random.Random(3), 60)
    docs = spark.createDataFrame([(i, text) for i, text, _ in rows], "doc_id long, text string")
    model = t.ToxicityModel(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    score, lam, *_ = _model([(text, y) for _, text, y in rows], [text for _, text, _ in rows])
    toxic, long = "idiot trash " * 3, "idiot trash some calm speech " * (BLOCK_BYTES // 29 + 1)
    for texts in ([long, "some calm speech", toxic, "", None, long, "calm speech", long], ["some calm speech"], [None, "calm", ""]):
        made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r for r in model.score(made).collect()}
        assert len(got) == len(texts)
        for i, text in enumerate(texts):
            assert got[i]["tokens"] == len(_features(text)) and bool(got[i]["passages"]) == (text in (toxic, long))
            if text != long:
                assert got[i]["evidence"] == pytest.approx(_evidence(text, score, lam))


def test_fold_of_ordinary_text(spark):
    """A fold of the sample in which no word is in the lexicon learnt without it."""
    texts = [*(f"idiot trash {w} fool" for w in "abcdefgh"), *(f"calm{i} speech{i}" for i in range(40))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(t.FOLDS)))
    docs = docs.where("fold > 0 or text like 'calm%'").drop("fold")
    labels = docs.selectExpr("doc_id", "int(text like 'idiot%') toxic")
    got = [(r["text"], r["score"]) for r in t.ToxicityModel(docs, labels).score(docs).join(docs, "doc_id").collect()]
    assert min(s for x, s in got if "idiot" in x) > max(s for x, s in got if "calm" in x)
