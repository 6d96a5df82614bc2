"""Parameters the registered queries pass to the text operators.

The input tables hold invented prose that the default word lists (in
``botqa.schemas``) almost never match, so the queries run with these test
dictionaries instead; the defaults are covered by hand-written unit tests.
"""

TEST_TOPICS = {
    "articles": ["the", "der"],
    "links": ["and", "und", "of"],
    "verbs": ["was", "is"],
    "none": ["refund"],
}
TEST_TONES = {
    "frustrated": ["wh"],
    "urgent": ["tion is"],
    "confused": ["the and"],
    "angry": ["zzz"],
    "positive": ["that"],
}
TEST_REFUSAL_PHRASES = ["the and", "tion the"]
TEST_PROHIBITED_ACTIONS = ["of_the", "in_and"]
TEST_INFORMAL_MARKERS = ["ur", "u ", "ya", "ngl"]

# fixed "now" for relative-time labels so results are repeatable
REPORT_NOW = "1999-01-01 00:00:00"
