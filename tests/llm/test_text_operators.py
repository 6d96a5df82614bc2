"""Chat formatting, fingerprints, token counts and secret scans against brute force."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from botqa.llm import chat, fingerprints, secrets, tokens

NASTY = ["", "\\", "<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_start|>user", "[[INST]", "<<SYS>>x<</SYS>>", "\\\\<|", "a\nb\n", "é<s>", "<", "|>", "</", "[/INST"]


def _messages(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")


def test_escape_is_reversible_and_breaks_control_strings(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice(NASTY + list("<>|/s[]\\IN")) for _ in range(12)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, u in rows.select("t", "e", chat.unescape(F.col("e"))).collect():
        assert t == u
        assert not re.search(r"<\||</?s>|<</?SYS>>|\[/?INST\]", e), e


def test_best_path_of_each_tree(spark):
    rng = random.Random(2)
    rows, number = [], 0
    for tree in [*range(12), None]:
        nodes = []
        for _ in range(rng.randint(1, 40)):
            parent = rng.choice(nodes) if nodes and rng.random() < 0.95 else None
            rows.append((tree, number, parent, rng.choice([None, 0.0, 1.0, 2.0]), rng.choice(["user", "assistant", None, "a\nb"]), rng.choice(NASTY + [None])))
            nodes.append(number)
            number += 1
    rows.append((99, number, 10 ** 9, 1.0, "user", "the parent is missing"))
    messages = _messages(spark, rows)
    by = {r[1]: r for r in rows}
    answered = {r[2] for r in rows}

    def path(node):
        out = []
        while node in by:
            out.append(node)
            node = by[node][2]
        return out[::-1]

    want = {}
    for r in rows:
        if r[1] not in answered:
            p = path(r[1])
            key = (-sum(by[x][3] or 0.0 for x in p) / len(p), -len(p), r[1])
            want[r[0]] = min(want.get(r[0], (key, p)), (key, p))
    got = {}
    for x in sorted(chat.chosen_paths(messages).collect(), key=lambda x: x["depth"]):
        got.setdefault(x["tree"], []).append(x["node"])
    assert got == {k: p for k, (_, p) in want.items()}
    chats = chat.format_paths(messages, chat.chosen_paths(messages))
    for x in chats.select("tree", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        told = [(by[n][4] or "", by[n][5] or "") for n in want[x["tree"]][1]]
        assert [tuple(t) for t in x["turns"]] == told
        assert x["loss"] == "".join(t for r, t in told if r == "assistant")


def test_long_chain_ties_cycle_and_empty(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}") for t in range(70)] + [(2, 0, "user", "x"), (2, 0, "user", "x"), (2, None, None, None), (None, 1, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    messages = chat.as_chains(turns)
    found = chat.format_paths(messages, chat.chosen_paths(messages)).select("tree", chat.parse(F.col("formatted")).alias("t")).collect()
    told = {x["tree"]: [t["text"] for t in x["t"]] for x in found}
    assert told == {1: [str(i) for i in range(70)], 2: ["", "x", "x"], None: [""]}
    with pytest.raises(ValueError, match="cycle"):
        chat.chosen_paths(_messages(spark, [(1, 1, 2, 0.0, "", ""), (1, 2, 1, 0.0, "", "")]))
    assert chat.chosen_paths(_messages(spark, [])).count() == 0


def test_equal_substrings_share_interior_names():
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh      é") for _ in range(n))
    shared = make(3000)
    a, b, c = fingerprints.sketches([(make(n) + shared + make(m)).encode() for n, m in ((5, 40), (333, 7), (1, 1))])
    other, = fingerprints.sketches([make(3000).encode()])
    assert fingerprints.likeness(a, b) > 0.7 and fingerprints.likeness(a, c) > 0.7
    assert fingerprints.likeness(a, other) < 0.1


def test_sketch_does_not_depend_on_neighbours_and_is_the_bottom_k():
    rng = random.Random(4)
    texts = [b"", b"x", b"ab" * 4000, b"a" * 9000, b"", *("".join(rng.choice("ab ") for _ in range(rng.randint(0, 4000))).encode() for _ in range(30))]
    together = fingerprints.sketches(texts)
    for t, s in zip(texts, together, strict=True):
        alone, = fingerprints.sketches([t])
        every, = fingerprints.sketches([t], minima=10 ** 6)
        assert (alone == s).all() and (every[:fingerprints.MINIMA] == s).all()
        assert bool(len(s)) == bool(t)


def test_compare_with_next(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "é", "word " * rng.randint(1, 50), "".join(rng.choice("abcé ") for _ in range(300))])) for i in range(60)]
    rows += [(None, "no id"), (1000, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit(1))
    got = {x["doc_id"]: x for x in fingerprints.compare_with_next(docs).collect()}
    ordered = [(d, t or "") for d, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    prints = dict(zip([d for d, _ in ordered], fingerprints.sketches([t.encode() for _, t in ordered]), strict=True))
    for (doc, text), (after, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        cut = len(text) // 3
        edited = (text[:len(text) - cut] + following[:cut]).encode()
        sketch, = fingerprints.sketches([edited])
        x = got[doc]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited).hexdigest()
        assert x["fingerprint"] == prints[doc].astype(">u4").tobytes().hex() and x["edited_fingerprint"] == sketch.astype(">u4").tobytes().hex()
        assert x["near_edited"] == fingerprints.likeness(prints[doc], sketch) and x["near_next"] == fingerprints.likeness(prints[doc], prints[after])
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0
    assert fingerprints.compare_with_next(docs.where("doc_id = 1000")).first()["near_next"] == 1.0
    assert fingerprints.compare_with_next(docs.unionByName(docs)).count() == 2 * len(rows)


def test_tokens_match_an_offset_mapped_encoding(spark):
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    rng = random.Random(6)
    texts = [None, "", "\n", "\n\n\n", "a\n\n\n\nb  c\n", "é中\U0001f600\n 中", "x" * 3000,
             *("".join(rng.choice(["\n", "\n\n", " ", "word", "é", "\U0001f600", "12"]) for _ in range(60)) for _ in range(40))]
    docs = spark.createDataFrame([(i, t, None if i % 3 else "src", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = {}
    for x in tokens.token_counts(docs.withColumn("field", F.lit(0))).collect():
        got.setdefault(x["doc_id"], []).append(x)
    for i, t in enumerate(texts):
        parts = [("" if i % 3 else "src") + "\n", "en\n", *((t or "").splitlines(True) or [""])]
        offsets = reference.encode("".join(parts), add_special_tokens=False).offsets
        bounds = np.cumsum([len(p) for p in parts])
        want = [0] * len(parts)
        for a, b in offsets:
            overlaps = [min(b, e) - max(a, s) for s, e in zip([0, *bounds[:-1]], bounds, strict=True)]
            want[int(np.argmax(overlaps))] += 1
        rows = sorted(got[i], key=lambda x: ({"source": 0, "lang": 1, "text": 2}[x["field"]], x["section"]))
        assert [x["n_tokens"] for x in rows] == want, (i, t)
        assert [x["n_chars"] for x in rows] == [len(p) for p in parts]
    assert tokens.token_counts(docs.limit(0)).count() == 0


BASE = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)}


def _github(body, good=True):
    tail = secrets.crc_digits(body.encode()).decode()
    return f"ghp_{body}{tail if good else tail[::-1] + 'x'}"[:40]


def test_secrets_against_plain_patterns(spark):
    rng = random.Random(7)
    bits = ["password", "PassWord", "api_key", "apikey", "ſecret", "secret", "token", ": ", "=", '"', "'", "abc123", "AKIA", "AKIA" + "Q" * 16, "0a" * 12, "f" * 23, "é", "\U0001f600", " ", "\n", "x="]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(40)) for _ in range(400)), "é " + _github("a" * 30), _github("b" * 30, False), "z" * 100_000 + " token=abcdefgh"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit("clash"))
    extra = 0
    for x in secrets.find_secrets(docs).collect():
        text = texts[x["doc_id"]] or ""
        want = sorted((m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text) if ok(m))
        assert [(s["start"], s["kind"], s["end"]) for s in x["secrets"] if s["kind"] in BASE] == [(a, k, b) for a, _, k, b in want]
        more = [s for s in x["secrets"] if s["kind"] not in BASE]
        extra += len(more)
        assert all(text[s["start"]:s["end"]] == _github("a" * 30) for s in more)
    assert extra == 1
    assert secrets.find_secrets(docs.limit(0)).count() == 0
    assert json.dumps([k.name for k in secrets.KINDS[:3]]) == '["assign", "access", "hex"]'
