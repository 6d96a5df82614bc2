"""Source divergence and phrase collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from botqa.llm import collocations, common, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, shard string"
UPPER = {c: c + 32 for c in range(65, 91)}


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)


def _texts(rng, n):
    stems = ["al", "ber", "chi", "dor", "é", "ß", "fan", "gel", "IN", "jo"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.choice([1, 1, 2, 3, 5])))
    known = [word() for _ in range(60)]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", "-", "1"]
    return ["".join(rng.choice(known) + rng.choice(gaps) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def _documents(seed=3, n=400):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(_texts(rng, n))]
    rows += [(1000 + i, "same words said again. same words said again", "en", "hot") for i in range(200)]
    rows += [rows[5], rows[5], (None, None, None, None), (None, "", "fr", "a"), (2000, None, "fr", "z"), (2001, "once " * 40_000, "de", "a"),
             (2002, "x" * 100_000, "de", "b"), (2003, "a" * 5000 + "b", "en", "a"), (2004, "1 2 3", "fr", "b")]
    rows += [(3000 + i, "q" * 4099 + " " + "q" * 4100, "en", "a") for i in range(31)]     # a kept term of many levels
    return rows


def _brute_divergence(rows, min_docs, top):
    docs = defaultdict(lambda: defaultdict(set))
    count, groups = defaultdict(Counter), set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER)):
            docs[lang][t].add(i)
            count[lang, source][t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if len(d) >= min_docs]
        sources = [s for x, s in groups if x == lang]
        size = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (size[s] + 5 * len(kept)) for t in kept} for s in sources}
        whole = sum(size.values())
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (whole + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_divergence(spark, cells):
    rows = _documents()
    got = [tuple(r) for r in divergence.divergence(_frame(spark, rows), 30, cells, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_divergence(rows, 30, 7)
    assert any(len(r[3]) == 4100 for r in got) or any(r[3].startswith("qqqq") for r in got if r[2] == "term")


def test_divergence_of_nothing(spark):
    assert divergence.divergence(_frame(spark, [])).count() == 0
    rows = [(1, "few words", "en", "a"), (2, None, "en", "b")]
    assert {tuple(r) for r in divergence.divergence(_frame(spark, rows)).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_levels_discard_prefixes(spark, monkeypatch):
    """Terms below a rare prefix are not counted."""
    rows = [(i, f"common{'abcdefghij'[i % 10]} rare{chr(97 + i % 26)}{chr(97 + i // 26)}zzzz", "en", "a") for i in range(60)]
    seen, staged = [], common.staged
    monkeypatch.setattr(divergence, "staged", lambda df, name: seen.append((name, staged(df, name))) or seen[-1][1])
    kept = divergence.kept_terms(_frame(spark, rows), 6)
    assert {r["term"] for r in kept.collect()} == {f"common{c}" for c in "abcdefghij"}
    terms = [df for name, df in seen if name == "terms"]
    assert terms[0].where("term is null and docs >= 6").count() == 2          # comm, rare
    assert terms[1].where("term like 'common%'").count() == 10                # of 7 bytes
    assert terms[-1].where("term like 'rare%' and length(term) > 8").count() == 0


def test_filter(spark):
    rng = np.random.default_rng(1)
    inside = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    found = common.HashFilter(spark.createDataFrame([(int(x),) for x in inside], "h long"))
    assert found.count == 5000 and found.has(inside.view(np.uint64)).all()
    assert found.has(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 0.2
    assert not common.HashFilter(spark.createDataFrame([], "h long")).has(inside.view(np.uint64)).any()


def _brute_phrases(rows, min_count, top):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    count["und" if lang is None else lang][tuple(w[i:i + k])] += 1
    out = set()
    for lang, f in count.items():
        best = []
        for x, a in f.items():
            if len(x) < 2 or a < min_count:
                continue
            if len(x) == 2 and any(len(y) == 3 and x in (y[:2], y[1:]) and b >= min_count and 100 * b >= 50 * a for y, b in f.items()):
                continue
            score, k = min((10**6 * a * a // (f[x[:k]] * f[x[k:]]), k) for k in range(1, len(x)))
            best.append((-score, -a, " ".join(x).encode(), f[x[:k]], f[x[k:]]))
        out |= {(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)}
    return out


@pytest.mark.parametrize("shards", [1, 4, 13])
def test_collocations(spark, shards):
    rows = _documents()
    got = [tuple(r) for r in collocations.collocations(_frame(spark, rows), 4, 40, shards).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_phrases(rows, 4, 40)
    assert {r[0] for r in got} >= {"en", "de", "und"}


def test_collocations_of_nothing(spark):
    assert collocations.collocations(_frame(spark, [])).count() == 0
    assert collocations.collocations(_frame(spark, [(None, None, None, None), (1, "a b a b", "en", "x")])).count() == 0


def test_shards_discard_phrases(spark):
    """With few shards, rare pairs are not counted exactly."""
    rng = random.Random(5)
    rows = [(i, "of the " + " ".join(f"w{rng.randint(0, 30)}" for _ in range(6)), "en", "a") for i in range(300)]
    found = collocations.Phrases(_frame(spark, rows), 100)
    assert {(r["phrase"], r["a"]) for r in found.counts.collect()} == {("of the", 300)}
    assert found.words.where("n < 100").count() == 0 and found.totals.first()["n"] == 2400


def test_scores_pass_64_bits(spark):
    a, left, right = 4_000_000_000_001, 5_000_000_000_003, 9_000_000_000_007
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score("a", "l", "r")).first()[0]
    assert got == 10**6 * a * a // (left * right)
    n, size, terms = 8_000_000_000_000, 9_123_456_789_123, 77_777
    p = spark.range(1).select(divergence.share(F.lit(n), F.lit(size), F.lit(terms))).first()[0]
    assert p == 1 + 10**9 * (n + 5) // (size + 5 * terms)
