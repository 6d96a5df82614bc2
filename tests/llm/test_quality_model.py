"""The quality model from n-grams to keys and decisions, against plain Python on bytes."""

import math
import random
import re

import pytest
import xxhash

from botqa.llm import quality as q

_M = (1 << 64) - 1


def _mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def _word_hash(word):
    """The polynomial hash of a span: the sum of (byte + 1) base**i, scrambled."""
    base = 0x9E3779B97F4A7C15 | 1
    return _mix(sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(word)) & _M)


def _shape(word, repeats):
    kinds = 64 if repeats else 0
    for b in word:
        c = chr(b)
        kinds |= 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 8 if b > 127 else 16 if c in ".,;:'-" else 32
    return kinds


def _ngrams(text, bits):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = [_word_hash(w) for w in words]
    shape = [_shape(w, i > 0 and words[i - 1] == w) for i, w in enumerate(words)]
    found = [_mix(x) for x in h]
    for i in range(1, len(words)):
        found.append(1 if words[i] == words[i - 1] else _mix((h[i - 1] * 3 + h[i]) & _M))
        found.append(_mix(((shape[i - 1] << 8) + shape[i] + (1 << 40)) & _M))
    return [x >> (64 - bits) for x in found]


def _noise(doc_id, seed):
    h = xxhash.xxh64_intdigest((doc_id & _M).to_bytes(8, "little"), 42) if doc_id is not None else 42
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)
    return -math.log(-math.log(((h >> 11) + 0.5) / 2.0 ** 53))


def _model(rows, labels, bits, seed):
    """(doc_id, ratio, key) of each row, the cut and k."""
    grams = [_ngrams(text, bits) for _, text in rows]
    raw, good = {}, {}
    for (i, _), some in zip(rows, grams, strict=True):
        for g in some:
            raw[g] = raw.get(g, 0) + 1
            if labels.get(i):
                good[g] = good.get(g, 0) + 1
    everything, target = sum(raw.values()) + 0.01 * 2 ** bits, sum(good.values())

    def ratio(g):
        p = (raw[g] + 0.01) / everything
        return math.log((good.get(g, 0) + q.PRIOR * p) / (target + q.PRIOR)) - math.log(p)
    scored = []
    for (i, _), some in zip(rows, grams, strict=True):
        r = sum(map(ratio, some)) / max(len(some), 1)
        scored.append((i, r, r * q.EFFECTIVE_LENGTH + _noise(i, seed)))
    known = sorted({(min(r for j, r, _ in scored if j == i), i) for i in labels})
    errors = {c: sum(labels[i] != (r >= c) for r, i in known) for c in [known[0][0] - 1, *((a[0] + b[0]) / 2 for a, b in zip(known, known[1:])), known[-1][0] + 1]}
    return scored, min(errors.values()), known


@pytest.mark.parametrize("bits", [6, 16])
def test_ratio_key_and_draw(spark, bits):
    rng = random.Random(bits)
    nice, bad = ["the", "Cat", "sat", "on", "réeux", "mats.", "it's"], ["BUY!!", "$$$", "now", "now", "$9", "the"]
    rows = [(i, " ".join(rng.choice(nice if i % 3 else bad) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    rows += [(200, ""), (201, None), (None, "Cat sat"), (5, rows[5][1])]
    labels = {i: bool(i % 3) for i in range(0, 150, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = q.Resampler(docs, spark.createDataFrame([(i, int(y)) for i, y in labels.items()], "doc_id long, quality int"), bits=bits)
    want, errors, known = _model(rows, labels, bits, fitted.seed)
    got = sorted(fitted.scores.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in want]
    assert [r["ratio"] for r in got] == pytest.approx([r[1] for r in want], abs=1e-9)
    assert [r["key"] / q.KEY_UNITS for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)
    assert sum(labels[i] != (r >= fitted.cut) for r, i in known) == errors  # no cut makes fewer
    k = sum(r >= fitted.cut for _, r, _ in want)
    assert 0 < fitted.k == k < len(rows)
    least = sorted((r[2] for r in want), reverse=True)[k - 1]
    kept = sorted(str(r["doc_id"]) for r in fitted.keep(docs).collect())
    assert kept == sorted(str(i) for i, _, key in want if key >= least - 1e-6)
