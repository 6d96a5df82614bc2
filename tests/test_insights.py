"""The insight row of a company (A-17) against the single extractions (A-09..A-16)."""

from pyspark.sql import functions as F

from botqa.operators import insights as I

WORDS = {"billing": ["refund", "bill"], "access": ["login", "pass word"], "unused": ["zzz"]}
TONES = {"angry": ["awful", "angry"], "happy": ["thanks", "great"]}
ROWS = [
    ("a", 1, 0, "user", "My refund is awful, the refund and the bill!!!", "customer escalated"),
    ("a", 1, 1, "assistant", "We have issued the refund, the case is closed.", "customer escalated"),
    ("a", 2, 0, "user", "Thanks, the login works and the pass word too", "resolved"),
    ("a", 2, 1, "assistant", "Great to hear, the ticket was resolved for good", "resolved"),
    ("a", 3, 0, "user", "My refund is awful, the refund and the bill!!!", "failed"),
    ("a", 4, 0, "user", "gonna login later", None),
    ("a", 5, 0, "user", "", "resolved"),
    ("a", 6, 0, "user", None, "resolved"),
    ("b", 7, 0, "user", "short", None),
    ("b", 7, 1, "assistant", "only the assistant says something long here", ""),
    ("c", 8, 0, "assistant", None, None),
]


def _conv(spark):
    return spark.createDataFrame(ROWS, "company string, conv_id long, turn int, role string, content string, outcome string")


def test_insights_hold_each_extraction(spark):
    conv = _conv(spark)
    t = I.tier_messages(conv)
    got = {r["company"]: r for r in I.insights(conv, taxonomy=WORDS, markers=("gonna",), tones=TONES).collect()}
    assert sorted(got) == ["a", "b", "c"]

    def lists(df, column):
        out = {}
        for r in df.orderBy("company", "rank").collect():
            out.setdefault(r["company"], []).append(r[column])
        return out

    for df, column, field in ((I.vocabulary(t), "word", "user_vocabulary"), (I.topics(t, WORDS), "topic", "top_issue_categories"),
                              (I.failure_triggers(t), "text", "failure_triggers"),
                              (I.successful_resolutions(t), "text", "successful_resolutions"),
                              (I.persona_hints(t), "hint", "extracted_personas")):
        want = lists(df, column)
        assert {c: r[field] for c, r in got.items()} == {c: want.get(c) for c in got}, field

    want = {}
    for r in I.emotional_tone(t, TONES, companies=conv).collect():
        want.setdefault(r["company"], {})[r["tone"]] = r["pct"]
    assert {c: r["emotional_tone_distribution"] for c, r in got.items()} == want
    assert want["c"] == {"neutral": 100.0}
    want = {r["company"]: r["avg_message_length"] for r in I.avg_message_length(t).collect()}
    assert {c: r["avg_message_length"] for c, r in got.items()} == {c: want.get(c) for c in got}
    want = {r["company"]: r["patterns"].split(",") for r in I.language_patterns(t, ("gonna",)).collect()}
    assert {c: r["dominant_language_patterns"] for c, r in got.items()} == {c: want.get(c) for c in got}
    assert {c: r["total_conversations_analyzed"] for c, r in got.items()} == {"a": 8, "b": 2, "c": 1}


def test_topics_and_tones_are_not_cut(spark):
    many = {f"topic{i:02d}": [f"word{i:02d}"] for i in range(60)}
    text = " ".join(f"word{i:02d}" for i in range(60))
    conv = spark.createDataFrame([("a", 1, 0, "user", text, None)],
                                 "company string, conv_id long, turn int, role string, content string, outcome string")
    row = I.insights(conv, taxonomy=many).first()
    assert row["top_issue_categories"] == sorted(many) and len(row["user_vocabulary"]) == 50
