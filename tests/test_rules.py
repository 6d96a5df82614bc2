"""Hand-worked edge cases for the rules, plus small
row-at-a-time restatements in plain Python (item 3)."""

import random

import pytest
from pyspark.sql import functions as F

from botqa import schemas as S
from botqa.functions import grades as G
from botqa.functions.numeric import py_round
from botqa.functions.replies import parse_judge_reply
from botqa.functions.text import py_strip, strip_fence
from botqa.operators import insights as I
from botqa.operators import judge as J
from botqa.operators import learn as L
from botqa.operators import plan as PL


# --------------------------------------------------------------------- A-03
def _panel_py(votes):
    """Plain restatement of the panel rule: votes = [(passed, type)]."""
    if not votes:
        return True, 0.0, "no_judges", None
    p = sum(1 for v, _ in votes if v)
    f = len(votes) - p
    if p == f:
        return False, 0.33, "tie", None
    maj = max(p, f)
    if maj == len(votes):
        conf, lvl = 0.95, "unanimous"
    elif maj == len(votes) - 1:
        conf, lvl = 0.75, "majority"
    else:
        conf, lvl = 0.33, "minority"
    ft = None
    if f > p:
        counts, first = {}, {}
        for i, (v, t) in enumerate(votes):
            if not v and t is not None:
                counts[t] = counts.get(t, 0) + 1
                first.setdefault(t, i)
        if counts:
            ft = sorted(counts, key=lambda t: (-counts[t], first[t]))[0]
    return f < p, conf, lvl, ft


def test_panel_vote_shapes(spark):
    cases = {
        1: [],                                                   # zero votes
        2: [(True, None)],                                       # single pass
        3: [(False, "HALLUCINATION"), (True, None)],             # tie
        4: [(False, "HALLUCINATION")] * 3,                       # unanimous fail
        5: [(False, "WRONG_ANSWER"), (False, "HALLUCINATION"), (True, None)],  # 2-1, type tie -> first seen
        6: [(False, "A_BAD"), (False, "POLICY_VIOLATION"), (True, None)],  # unknown type ignored
        7: [(True, None), (True, None), (True, None), (False, "INCOMPLETE"), (False, "INCOMPLETE")],  # 3-2 minority
        8: [(False, "INCOMPLETE"), (False, "CONTEXT_LOSS"), (False, "CONTEXT_LOSS"), (True, None), (False, None)],
    }
    rows = [(sid, slot, v, t) for sid, vs in cases.items() for slot, (v, t) in enumerate(vs)]
    vdf = spark.createDataFrame(rows, "scenario_id long, slot int, passed boolean, failure_type string")
    sdf = spark.createDataFrame([(k,) for k in cases], "scenario_id long")
    got = {r.scenario_id: r for r in J.panel_verdict(vdf, sdf).collect()}
    for sid, votes in cases.items():
        clean = [(v, t if t in S.FAILURE_TYPES else None) for v, t in votes]
        passed, conf, lvl, ft = _panel_py(clean)
        r = got[sid]
        assert (r.passed, r.confidence, r.agreement_level, r.failure_type) == (passed, conf, lvl, ft), sid
    assert got[7].requires_human_review and got[3].requires_human_review and got[1].requires_human_review
    assert not got[4].requires_human_review


def test_panel_random_against_python(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for sid in range(300):
        n = rnd.randint(0, 5)
        votes = [(rnd.random() < 0.5, rnd.choice([None, "HALLUCINATION", "WRONG_ANSWER", "INCOMPLETE"]))
                 for _ in range(n)]
        votes = [(v, None if v else t) for v, t in votes]
        expect[sid] = _panel_py(votes)
        rows += [(sid, i, v, t) for i, (v, t) in enumerate(votes)]
    vdf = spark.createDataFrame(rows, "scenario_id long, slot int, passed boolean, failure_type string")
    sdf = spark.createDataFrame([(k,) for k in expect], "scenario_id long")
    for r in J.panel_verdict(vdf, sdf).collect():
        assert (r.passed, r.confidence, r.agreement_level, r.failure_type) == expect[r.scenario_id]


# --------------------------------------------------------------------- P-03
def test_rule_order_and_question_exemption(spark):
    rows = [
        (1, "why?", None),                                 # no reply -> not a rule (error path)
        (2, "hello", "   abcd  "),                          # 4 chars stripped -> INCOMPLETE
        (3, "hello", "abcde"),                              # exactly 5 -> passes rule a
        (4, "hello", "Sorry, I CANNOT HELP with that."),    # refusal -> INCOMPLETE
        (5, "can you?", "Sorry, I cannot help with that."),  # question exempts refusal
        (6, "hello", "We will Delete Account now"),         # prohibited action -> POLICY_VIOLATION
        (7, "hello", "\n\t    "),                     # unicode whitespace only -> INCOMPLETE
    ]
    df = spark.createDataFrame(rows, "scenario_id long, input string, actual_response string")
    out = {r.scenario_id: r.rule_failure for r in
           J.apply_rules(df, prohibited_actions=["delete_account"]).collect()}
    assert out == {1: None, 2: "INCOMPLETE", 3: None, 4: "INCOMPLETE", 5: None, 6: "POLICY_VIOLATION",
                   7: "INCOMPLETE"}
    res = {r.scenario_id: r for r in J.assemble_results(J.apply_rules(df), None).collect()}
    assert res[1].actual_response.startswith("ERROR:") and res[1].failure_type == "INCOMPLETE"
    assert res[1].confidence_score == 0.95 and res[1].evaluation_method == "RULE_BASED"
    assert res[3].evaluation_method == "HYBRID" and res[3].passed and res[3].confidence_score == 0.0


# ---------------------------------------------------------------- S-06/S-07
def test_judge_reply_shapes(spark):
    raws = {
        1: '```json\n{"passed": false, "failure_type": "HALLUCINATION"}\n```',
        2: '```\n{"passed": true}',                         # fence without closing
        3: '[{"passed": true}]',                             # array where an object is due
        4: 'no json here',
        5: '{"confidence": null}',                           # float(None) fails -> no verdict
        6: '{"passed": null, "confidence": "0.4"}',         # bool(None) False; "0.4" -> 0.4
        7: '{"failure_type": "NOT_A_TYPE"}',
    }
    df = spark.createDataFrame(list(raws.items()), "id long, raw string")
    out = {r.id: r.v for r in df.select("id", parse_judge_reply(F.col("raw")).alias("v")).collect()}
    assert out[1].valid and out[1].passed is False and out[1].failure_type == "HALLUCINATION"
    assert out[1].confidence == 0.75 and out[1].reasoning == ""
    assert out[2].valid and out[2].passed is True
    assert not out[3].valid and not out[4].valid and not out[5].valid
    assert out[6].valid and out[6].passed is False and out[6].confidence == 0.4
    assert out[7].valid and out[7].passed is True and out[7].failure_type is None


def test_strip_fence_matches_python(spark):
    samples = ["```json\n{}\n```", "  ```\nabc", "plain", "```json{}``` trailing ```", "jsonx", "```", ""]
    df = spark.createDataFrame([(s,) for s in samples], "raw string")
    got = [r[0] for r in df.select(strip_fence(F.col("raw"))).collect()]

    def py(raw):
        raw = raw.strip()
        if raw.startswith("```"):
            parts = raw.split("```")
            raw = parts[1]
            if raw.startswith("json"):
                raw = raw[4:]
        return raw.strip()
    assert got == [py(s) for s in samples]


# --------------------------------------------------------------------- A-22
def _sticky_py(events):
    state = {}
    for key, found in events:
        t, f, st = state.get(key, (0, 0, None))
        t, f = t + 1, f + int(found)
        if t == 1:
            st = "active"
        elif f / t >= 0.40:
            st = "high_value"
        elif f / t <= 0.05 and t >= 5:
            st = "retired"
        state[key] = (t, f, st)
    return state


@pytest.mark.parametrize("bucket", [3, 1000])
def test_persona_stickiness(spark, bucket):
    rnd = random.Random(3)
    events = []
    for i in range(600):
        p = rnd.choice(["a", "b", "c", "d"])
        rate = {"a": 0.02, "b": 0.5, "c": 0.2, "d": 0.0}[p]
        events.append(((p, "RAG"), rnd.random() < rate))
    # a persona that is high value early and then cools down keeps its status
    events += [(("e", "RAG"), True), (("e", "RAG"), True)] + [(("e", "RAG"), False)] * 2
    rows = [(i, k[0], k[1], f) for i, (k, f) in enumerate(events)]
    df = spark.createDataFrame(rows, "ord long, persona string, system_type string, found_failure boolean")
    got = {(r.persona, r.system_type): (r.times_used, r.failures, r.status)
           for r in L.persona_effectiveness(df, bucket_width=bucket).collect()}
    assert got == _sticky_py(events)
    assert got[("e", "RAG")][2] == "high_value"


# --------------------------------------------------------------------- W-01
def test_budget_cutoff(spark):
    costs = spark.createDataFrame([("r1", 0, 0.5), ("r1", 1, 0.5), ("r1", 2, 0.5),
                                   ("r2", 0, 2.0), ("r2", 1, 0.1),
                                   ("r3", 0, 5.0), ("r3", 1, 5.0),
                                   ("r4", 0, 5.0), ("r4", 1, 5.0)],
                                  "run_id string, batch_id int, batch_cost double")
    budgets = spark.createDataFrame([("r1", 1.0), ("r2", 1.0), ("r3", 0.0), ("r4", None)],
                                    "run_id string, budget_usd double")
    out = {(r.run_id, r.batch_id): r.kept for r in J.budget_cutoff(costs, budgets).collect()}
    assert out[("r1", 0)] and out[("r1", 1)] and not out[("r1", 2)]       # 1.0 spent before batch 2
    assert out[("r2", 0)] and not out[("r2", 1)]                          # first batch over budget
    assert out[("r3", 1)] and out[("r4", 1)]                              # 0 / null = no limit


# --------------------------------------------------------------------- A-14
def test_tone_first_match_and_neutral_default(spark):
    conv = spark.createDataFrame([
        ("c1", 1, 1, "user", "this is urgent and I am frustrated!!!", "x"),   # frustrated wins (first)
        ("c1", 1, 2, "user", "thank you, that was helpful indeed", "x"),
        ("c1", 1, 3, "user", "just some words without any tone at all", "x"),
        ("c1", 1, 4, "user", "short", "x"),                                   # LOW tier: not counted
        ("c2", 2, 1, "assistant", "assistant text is never counted here", "x"),
    ], "company string, conv_id long, turn long, role string, content string, outcome string")
    out = {(r.company, r.tone): r.pct for r in I.emotional_tone(I.tier_messages(conv), companies=conv).collect()}
    assert out == {("c1", "frustrated"): 33.3, ("c1", "positive"): 33.3, ("c1", "neutral"): 33.3,
                   ("c2", "neutral"): 100.0}


def test_incorrect_is_both_failure_and_success_outcome(spark):
    """T8: 'incorrect' contains 'correct' — the role filter separates them."""
    conv = spark.createDataFrame([
        ("c", 1, 1, "user", "the user message that is long enough", "incorrect answer"),
        ("c", 1, 2, "assistant", "the assistant message long enough too", "incorrect answer"),
    ], "company string, conv_id long, turn long, role string, content string, outcome string")
    t = I.tier_messages(conv)
    assert [r.text for r in I.failure_triggers(t).collect()] == ["the user message that is long enough"]
    assert [r.text for r in I.successful_resolutions(t).collect()] == ["the assistant message long enough too"]


def test_default_dictionaries_vocabulary_and_topics(spark):
    conv = spark.createDataFrame([
        ("c", 1, 1, "user", "Where is my ORDER? The order was shipped, tracking says lost.", "bad"),
        ("c", 2, 1, "user", "I want a refund, the item arrived broken; refund please!", None),
        ("c", 3, 1, "user", "Refund?", None),
    ], "company string, conv_id long, turn long, role string, content string, outcome string")
    t = I.tier_messages(conv)
    vocab = [r.word for r in I.vocabulary(t).orderBy("rank").collect()]
    # counts: order 2, refund 3 ('refund?' -> 'refund'), others 1; ties by first occurrence
    assert vocab[:3] == ["refund", "order", "shipped"]
    assert "the" not in vocab and "is" not in vocab
    topics = [(r.topic, r.n) for r in I.topics(t).orderBy("rank").collect()]
    assert topics[0][0] == "order_tracking"
    assert dict(topics)["returns_refunds"] >= 3


def test_tier_boundaries(spark):
    conv = spark.createDataFrame([
        ("c", 1, 1, "user", "x" * 20, "ok"), ("c", 1, 2, "user", "x" * 21, "ok"),
        ("c", 1, 3, "user", "x" * 21, ""), ("c", 1, 4, "user", "", "ok"),
    ], "company string, conv_id long, turn long, role string, content string, outcome string")
    tiers = {r.turn: r.tier for r in I.tier_messages(conv).collect()}
    assert tiers == {1: "LOW", 2: "HIGH", 3: "MEDIUM"}


# ------------------------------------------------------------- P-13, P-14
def test_grades_and_verdict_variants(spark):
    df = spark.createDataFrame([(0.795, 5), (0.8, 5), (0.85, 9), (0.895, 10), (None, 0)],
                               "rate double, failures int")
    out = df.select(G.grade_letter("rate").alias("g"), G.deploy_safe("rate", "failures").alias("raw"),
                    G.deploy_safe_rounded("rate", "failures").alias("rounded")).collect()
    assert [r.g for r in out] == ["B", "B", "B", "A", "F"]
    # T10: 0.795 is unsafe on the raw test, safe on the rounded one
    assert (out[0].raw, out[0].rounded) == (False, True)
    assert out[1].raw and not out[3].raw


# --------------------------------------------------------------------- P-17/18
def test_maturity_and_mix(spark):
    df = spark.createDataFrame([(False, None, "RELIABLE", 200, "SMART_MIX"), (True, 0.85, "NEW", 200, "SMART_MIX"),
                                (True, 0.5, "NEW", 7, "SMART_MIX"), (True, 0.9, "RUNNING", 10, "FROM_FAILURES")],
                               "hist boolean, rate double, cfg string, total int, strategy string")
    out = df.select(PL.maturity(F.col("hist"), F.col("rate"), F.col("cfg")).alias("m"), "total", "strategy")
    out = out.select("m", PL.scenario_mix(F.col("total"), F.col("m"), F.col("strategy")).alias("mix")).collect()
    assert [r.m for r in out] == ["NEW", "RELIABLE", "RUNNING", "RUNNING"]
    assert tuple(out[0].mix) == (200, 0, 0)
    assert tuple(out[1].mix) == (40, 120, 40)
    assert tuple(out[2].mix) == (3, 2, 2)        # int() truncation, remainder adversarial
    assert tuple(out[3].mix) == (0, 10, 0)


# --------------------------------------------------------------------- S-18
def test_py_round_matches_python(spark):
    vals = [2.675, 0.125, 0.375, 1.005, 6.25, 0.15, 12.345, 99.95, -2.5, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for n in (1, 2):
        got = [r[0] for r in df.select(py_round("v", n)).collect()]
        assert got == [round(v, n) for v in vals]


def test_py_strip_unicode(spark):
    df = spark.createDataFrame([("  x y \n",)], "s string")
    assert df.select(py_strip("s")).first()[0] == "  x y \n".strip()


# ------------------------------------------------------ distributed ranking
@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_ranked_matches_row_number(spark, width):
    from pyspark.sql import Window
    from botqa.operators.ranking import ranked
    rnd = random.Random(11)
    rows = [(rnd.choice("abc"), i, rnd.randint(0, 3)) for i in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    got = {(r.k, r.seq): (r.rank, r.s) for r in ranked(df, ["k"], "seq", width, sums={"s": F.col("v")}).collect()}
    w = Window.partitionBy("k").orderBy("seq")
    exp = {(r.k, r.seq): (r.rn, r.s) for r in df.select(
        "k", "seq", F.row_number().over(w).alias("rn"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    assert got == exp


def test_mix_ratio_override(spark):
    df = spark.createDataFrame([(100, "RUNNING")], "total int, m string")
    mix = df.select(PL.scenario_mix(F.col("total"), F.col("m"), F.lit("SMART_MIX"),
                                    ratios={"RUNNING": (0.1, 0.6, 0.3)}).alias("mix")).first().mix
    assert tuple(mix) == (10, 60, 30)
    default = df.select(PL.scenario_mix(F.col("total"), F.col("m"), F.lit("SMART_MIX")).alias("mix")).first().mix
    assert tuple(default) == (50, 30, 20)


def test_reply_keys_are_read_at_the_top_level(spark):
    from botqa.functions.replies import json_str
    rows = [('{"meta": {"input": 5}, "input": "hello"}', "hello"), ('{"meta": {"input": "deep"}, "input": 5}', None),
            ('{"input": "a", "input": "b"}', "b"), ('{"other": "\\"input\\": 1", "input": "x"}', "x"), ('{"input": null}', None),
            ('{"input": {"a": 1}}', None), ("[1]", None), ("no json", None), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "j string").select("j", json_str("j", "input").alias("v")).collect()
    assert [(r.j, r.v) for r in got] == rows
