"""Sharding, decontamination, SimHash, toxicity, quality and mixing against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from botqa.llm import decontaminate, mixing, quality, sharding, simhash, toxicity

SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def _image(x, n, seed):
    """The Feistel pass in plain Python."""
    a, b = sharding._halves(n)
    left, right = divmod(x, b)
    for i in range(sharding.ROUNDS):
        of = right if i % 2 == 0 else left
        h = xxhash.xxh64_intdigest(int(seed * sharding.ROUNDS + i).to_bytes(4, "little"), xxhash.xxh64_intdigest(of.to_bytes(8, "little"), 42))
        h = h - (1 << 64) if h >> 63 else h
        if i % 2 == 0:
            left = (left + h % a) % a
        else:
            right = (right + h % b) % b
    return left * b + right


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 37, 200])
def test_shards(spark, n):
    rows = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.lit("x").alias("slot"), F.lit(1).alias("_at"))
    got = sharding.assign_shards(rows, [F.col("doc_id")], 16, seed=5).collect()
    want = {}
    for r in range(n):
        p = _image(r, n, 5)
        while p >= n:
            p = _image(p, n, 5)
        want[3 * r] = (r, p, p % 16, p // 16)
    assert {x["doc_id"]: (x["row_number"], x["position"], x["shard"], x["slot"]) for x in got} == want
    assert sorted(x["position"] for x in got) == list(range(n))


def test_shards_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1)] * 40 + [(4, 1)] * 30 + [(5, None)], "doc_id long, x long")
    got = sharding.assign_shards(rows, [F.col("doc_id"), F.col("x")], 4).collect()
    assert sorted(x["row_number"] for x in got) == list(range(71))
    assert all(x["doc_id"] is None for x in got if x["row_number"] < 40)
    for s in range(4):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(len([x for x in got if x["shard"] == s])))
    assert sharding.assign_shards(rows.limit(0), [F.col("doc_id")], 4).count() == 0


def _shingles(text, size=5):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_containment(spark):
    rng = random.Random(1)
    vocabulary = ["w%d" % i for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 5, 6, 9, 14, 40, 70]))) for i in range(40)] + [(100, None), (101, ""), (None, say(30)), (102, " A b\tC d E\nF ")]
    docs = []
    for i in range(300):
        words = say(rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 2)):
            part = (rng.choice(items)[1] or "").split()
            for j in range(len(part)):
                if rng.random() < 0.02:
                    part[j] = "edited"
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs.append((i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    docs += [docs[3], (None, docs[5][1]), (None, None), (400, None), (401, "w1 " * 30_000 + items[6][1] + " end" * 9)]
    want = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = _shingles(item), _shingles(text)
        if a and len(a & b) / len(a) >= 0.8:
            want.add((d, hash(text), i, len(a), len(a & b)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("_h", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit("clash"))
    got = decontaminate.contained_items(frame, bench).collect()
    texts = {(d, t) for d, t in docs}
    key = {r["h"]: r["text"] for r in frame.select(F.xxhash64("text").alias("h"), "text").collect()}
    found = {(x["doc_id"], hash(key[x["text_hash"]]), x["item_id"], x["n_item"], x["n_shared"]) for x in got}
    assert found == want and len(got) == len(want) > 40 and texts
    left = decontaminate.without_leaks(frame, bench)
    dirty = {(d, h) for d, h, *_ in want}
    assert left.columns == frame.columns
    assert sorted((str(x["doc_id"]), x["text"] or "") for x in left.collect()) == sorted((str(d), t or "") for d, t in docs if (d, hash(t)) not in dirty)
    assert decontaminate.without_leaks(frame, bench.limit(0)).count() == len(docs)
    assert decontaminate.contained_items(frame.limit(0), bench).count() == 0


def _fingerprint(text):
    """The contract's fingerprint in plain Python."""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(nodes), 2):
        if near(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("block", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = random.Random(block)
    nodes = {0, (1 << 63) - 1, -1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            nodes.add(y - (1 << 64) if y >> 63 else y)
            if rng.random() < 0.3:
                x = y
    want = _components(nodes, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    edges = simhash.links(spark.createDataFrame([(x,) for x in nodes], "fp long"), block=block)
    got = {x["node"]: x["root"] for x in simhash.components(edges).collect()}
    assert {x: got.get(x, x) for x in nodes} == want
    assert len(got) > 100


def test_near_duplicates(spark):
    rng = random.Random(9)
    docs = []
    for i in range(60):
        words = [rng.choice(["Alpha", "beta", "GAMMA", "é", "ẞ", "ÀB", " x"]) + str(rng.randint(0, 50)) for _ in range(rng.choice([0, 1, 2, 3, 50, 400]))]
        docs.append((i, rng.choice([" ", "\n", "\x0b\t"]).join(words)))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                if copy:
                    copy[rng.randrange(len(copy))] = "other"
            docs.append((len(docs) + 1000, " ".join(copy)))
    docs += [(5000, None), (5001, ""), docs[7], (None, docs[9][1]), (None, "only here and nowhere else in this table"), (6000, "long text " * 60_000)]
    prints = [_fingerprint(t) for _, t in docs]
    group = _components(set(prints), lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {}
    for (d, _), p in zip(docs, prints, strict=True):
        if d is not None:
            least[group[p]] = min(least.get(group[p], d), d)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = sorted(((x["doc_id"] if x["doc_id"] is not None else -1, x["fp"] % (1 << 64), x["component_id"]) for x in simhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted(((d if d is not None else -1, p, least.get(group[p])) for (d, _), p in zip(docs, prints, strict=True)), key=str)
    kept = simhash.first_of_each(frame)
    assert kept.columns == frame.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(least.values())) and ids.count(None) == 2
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Rows of one id with unlike texts are documents of their own; equal rows and
    copies under other ids go; rows without an id stay."""
    rng = random.Random(8)
    texts = [" ".join("w%d" % rng.randrange(500) for _ in range(60)) for _ in range(4)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (7, texts[1]), (3, texts[2]), (9, texts[2]), (None, texts[2]), (None, texts[3]), (8, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", F.lit(1)).withColumn("fp", F.lit("clash"))
    got = simhash.first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted(
        [(5, texts[0]), (5, texts[1]), (3, texts[2]), (0, texts[2]), (0, texts[3]), (2, "")])


def test_every_close_pair_meets_under_a_chain_key(spark):
    rng = random.Random(11)
    pairs = []
    for i in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        pairs.append((i, x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    frame = spark.createDataFrame(pairs, "i long, x long, y long")
    keys = simhash.chain_keys(frame.select(F.explode(F.array("x", "y")).alias("fp")))
    a, b = keys.toDF("key", "x", "fx"), keys.toDF("key2", "y", "fy")
    met = frame.join(a, "x").join(b, "y").where("key = key2 and (fx or fy)").select("i").distinct().count()
    assert met == 400


def test_maximal_segments():
    rng = random.Random(12)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        total = np.concatenate([[0], np.cumsum(scores)])
        positive = [i for i, s in enumerate(scores) if s > 0]
        got = [(positive[a], positive[b]) for a, b in toxicity.maximal_segments([total[i] for i in positive], [total[i + 1] for i in positive])]

        def split(lo, hi):  # the definition: the best segment (shortest, leftmost), then the rest on both sides
            best = max(((total[j + 1] - total[i], -(j - i), -i) for i in range(lo, hi) for j in range(i, hi)), default=None)
            if best is None or best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return [*split(lo, i), (i, j), *split(j + 1, hi)]
        assert sum(total[b + 1] - total[a] for a, b in got) == pytest.approx(sum(total[b + 1] - total[a] for a, b in split(0, len(scores))))
        assert {total[b + 1] - total[a] for a, b in got} == {total[b + 1] - total[a] for a, b in split(0, len(scores))}


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.ToxicityModel(docs, labels, ~held_out)
    x = model.score(docs).where(held_out).join(labels, "doc_id").toPandas()
    assert len(x) > 500
    hit = x.score >= 0.3
    assert (hit & (x.toxic == 1)).sum() / (x.toxic == 1).sum() > 0.75
    assert (hit & (x.toxic == 0)).sum() / (x.toxic == 0).sum() < 0.01
    texts = {r["doc_id"]: r["text"] for r in docs.join(labels.where("toxic = 1"), "doc_id").collect()}
    for doc, passages in zip(x.doc_id[hit], x.passages[hit], strict=True):
        for p in passages:
            assert 0 <= p["start"] < p["end"] <= len(texts.get(doc, "x" * 10 ** 6)) and p["expected"] < 1


def test_toxicity_edges(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (4, "idiot"), (4, "idiot"), (5, "word " * 100_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    both = spark.createDataFrame([(4, 1), (5, 0), (5, 0)], "doc_id long, toxic int")
    for labels in (none, one, both):
        got = toxicity.ToxicityModel(odd, labels).score(odd).collect()
        assert len(got) == 6 and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity.ToxicityModel(odd.limit(0), both).score(odd.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    found = quality.quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert found.keep[found.quality == 1].mean() > 0.99
    assert found.keep[found.quality == 0].mean() < 0.05


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (4, "good words here"), (4, "good words here"), (5, "BAD!! " * 100_000)], "doc_id long, text string")
    docs = docs.withColumn("_ratio", F.lit("clash")).withColumn("key", F.lit(0))
    none = spark.createDataFrame([], "doc_id long, quality int")
    both = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.Resampler(docs, none).keep(docs).count() == 6
    fitted = quality.Resampler(docs, both)
    kept = fitted.keep(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} >= {4} and 5 not in {x["doc_id"] for x in kept.collect()}
    assert kept.where("doc_id = 4").count() == 2
    assert quality.Resampler(docs, both, share=0.0).keep(docs).count() == 0
    assert quality.Resampler(docs.limit(0), both).keep(docs.limit(0)).count() == 0


def test_kth_largest(spark):
    rng = random.Random(13)
    for values in ([5], [3] * 9, [rng.randint(-10 ** 12, 10 ** 12) for _ in range(500)], [rng.randint(0, 70_000) for _ in range(300)]):
        frame = spark.createDataFrame([(v,) for v in values], "v long")
        for k in {1, len(values), (len(values) + 1) // 2}:
            assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_best_cut():
    good = np.array([True, True, False, False])
    assert quality.best_cut(np.array([5.0, 4.0, 1.0, 0.0]), good) == 2.5
    assert quality.best_cut(np.array([1.0]), np.array([True])) is None


def _level(sizes):
    """Targets by the contract's rule, in plain Python."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "B", "é", "src1", "src10", "src2", ""][:rng.randint(1, 8)]
    docs = [(i, rng.choice(names + names[:1] * 5), rng.choice([None, "", " ", *("w " * rng.randint(1, 90) for _ in range(5))])) for i in range(700)]
    docs += [docs[0], docs[0], (None, names[-1], "no id at all")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("payload", F.lit(1))
    placed = mixing.place(mixing.sized(frame)).collect()
    sizes = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = _level(sizes)
    assert len(placed) == len(docs)
    for s in sizes:
        own = [x for x in placed if x["source"] == s]
        assert all(x["target"] == pytest.approx(target[s]) and x["source_size"] == sizes[s] for x in own)
        assert abs(sum(x["taken"] for x in own) - target[s]) <= max(x["size"] for x in own)
        assert all(0 <= x["taken"] <= 3 * x["size"] for x in own)
    rows = mixing.copies_by_position(mixing.place(mixing.sized(frame))).collect()
    assert sorted(x["at"] for x in rows) == [x["at"] for x in rows] and all(0 <= x["at"] <= 1 for x in rows)
    # the schedule: by time t a source has given the share of its target that its weight integrates to
    for s in sizes:
        own = [x for x in rows if x["source"] == s]
        if sum(x["size"] for x in own) > 2000:
            tilt = mixing.TILT if own[0]["place"] % 2 == 0 else -mixing.TILT
            for t in (0.25, 0.5, 0.75):
                given = sum(x["size"] for x in own if x["at"] <= t) / target[s]
                assert given == pytest.approx((1 - tilt) * t + tilt * t * t, abs=0.06)
    whole = mixing.mixed_documents(frame)
    assert whole.columns == frame.columns
    assert whole.count() == sum(x["copies"] for x in placed)
    assert mixing.mixed_documents(frame.limit(0)).count() == 0
    assert math.isfinite(sum(target.values()))
