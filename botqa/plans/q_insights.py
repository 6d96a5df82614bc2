"""Registered queries: conversation insights (P-06, A-09..A-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import insights as I
from ..sources import fixtures as FX
from . import params as PP
from .registry import QUERIES, register

# tiered messages, as SQL
_TIER = """
WITH t AS (
  SELECT *, CASE WHEN length(content) > 20 AND outcome IS NOT NULL AND length(outcome) > 0 THEN 'HIGH'
                 WHEN length(content) > 20 THEN 'MEDIUM' ELSE 'LOW' END AS tier
  FROM conv WHERE content IS NOT NULL AND content <> '')
"""


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _sql_any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _tiered(t):
    return I.tier_messages(FX.conv(t))


@register("P06_conversation_tiers", _TIER + "SELECT conv_id, turn, company, role, tier FROM t")
def p06_tiers(t):
    """P-06 quality tier per message (empty content dropped)."""
    return _tiered(t).select("conv_id", "turn", "company", "role", "tier")


_PUNCT = S.VOCAB_PUNCTUATION.replace("'", "''")
_A09_SQL = _TIER + f""",
u AS (
  SELECT company, conv_id, turn,
         regexp_replace(translate(lower(content), '{_PUNCT}', '{' ' * len(S.VOCAB_PUNCTUATION)}'),
                        '^\\s+|\\s+$', '', 'g') AS s
  FROM t WHERE role = 'user'),
l AS (SELECT company, conv_id, turn, CASE WHEN s = '' THEN [] ELSE string_split_regex(s, '\\s+') END AS ws FROM u),
w AS (SELECT company, conv_id, turn, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM l),
g AS (
  SELECT company, word, COUNT(*) AS n, min({{'c': conv_id, 't': turn, 'p': pos}}) AS f
  FROM w WHERE length(word) > 2 AND NOT list_contains({_sql_list(S.STOP_WORDS)}, word)
  GROUP BY company, word),
r AS (SELECT company, word, n, ROW_NUMBER() OVER (PARTITION BY company ORDER BY n DESC, f) AS rank FROM g)
SELECT company, CAST(rank AS INT) AS rank, word, n FROM r WHERE rank <= 50
"""


@register("A09_vocabulary", _A09_SQL)
def a09_vocabulary(t):
    """A-09 top-50 user words per company (reference stop words)."""
    return I.vocabulary(_tiered(t)).withColumn("rank", F.col("rank").cast("int"))


def _topic_sql(taxonomy):
    parts = []
    for i, (topic, kws) in enumerate(taxonomy.items()):
        terms = " + ".join(
            f"CAST((length(low) - length(replace(low, '{k}', ''))) / {len(k)} AS BIGINT)" for k in kws)
        parts.append(f"SELECT company, {i} AS topic_ord, '{topic}' AS topic, {terms} AS n FROM m")
    union = "\nUNION ALL\n".join(parts)
    return _TIER + f""",
m AS (SELECT company, lower(content) AS low FROM t WHERE tier IN ('HIGH', 'MEDIUM') AND role = 'user'),
x AS ({union}),
g AS (SELECT company, topic_ord, topic, CAST(SUM(n) AS BIGINT) AS n FROM x GROUP BY ALL HAVING SUM(n) > 0)
SELECT company, CAST(ROW_NUMBER() OVER (PARTITION BY company ORDER BY n DESC, topic_ord) AS INT) AS rank, topic, n
FROM g
"""


@register("A10_topics", _topic_sql(PP.TEST_TOPICS))
def a10_topics(t):
    """A-10 topic keyword counts per company (test taxonomy)."""
    return I.topics(_tiered(t), PP.TEST_TOPICS).withColumn("rank", F.col("rank").cast("int"))


def _lang_sql(markers):
    joined = "string_agg(lower(content), ' ' ORDER BY conv_id, turn)"
    flags = " + ".join(f"CASE WHEN contains(alltext, '{m}') THEN 1 ELSE 0 END" for m in markers)
    return _TIER + f""",
m AS (SELECT * FROM t WHERE tier IN ('HIGH', 'MEDIUM') AND role = 'user'),
g AS (
  SELECT company, COUNT(*) AS n_msgs, AVG(length(content)) AS avg_len,
         SUM(CASE WHEN length(content) - length(regexp_replace(content, '\\p{{Lu}}', '', 'g')) > length(content) * 0.4 THEN 1 ELSE 0 END) AS caps,
         SUM(CASE WHEN regexp_matches(content, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END) AS nonascii,
         SUM(CASE WHEN (length(content) - length(replace(content, '!', ''))) + (length(content) - length(replace(content, '?', ''))) > 2 THEN 1 ELSE 0 END) AS punct,
         {joined} AS alltext
  FROM m GROUP BY company),
f AS (SELECT *, {flags} AS informal FROM g)
SELECT company, n_msgs, CAST(informal AS BIGINT) AS informal_markers,
       concat_ws(',',
         CASE WHEN avg_len < 30 THEN 'very_short_messages' WHEN avg_len < 80 THEN 'short_messages'
              WHEN avg_len < 200 THEN 'medium_length_messages' ELSE 'long_detailed_messages' END,
         CASE WHEN informal > n_msgs * 0.3 THEN 'informal_language' WHEN informal < n_msgs * 0.1 THEN 'formal_language'
              ELSE 'mixed_formality' END,
         CASE WHEN caps > n_msgs * 0.2 THEN 'frequent_caps_usage' END,
         CASE WHEN nonascii > n_msgs * 0.3 THEN 'heavy_emoji_usage' WHEN nonascii > n_msgs * 0.1 THEN 'occasional_emoji_usage' END,
         CASE WHEN punct > n_msgs * 0.2 THEN 'heavy_punctuation' END) AS patterns
FROM f
"""


@register("A11_language_patterns", _lang_sql(PP.TEST_INFORMAL_MARKERS))
def a11_language_patterns(t):
    """A-11 language pattern labels per company (test informal markers)."""
    return I.language_patterns(_tiered(t), PP.TEST_INFORMAL_MARKERS)


def _distinct_sql(role, words, tier="HIGH"):
    return _TIER + f""",
f AS (SELECT company, content, min({{'c': conv_id, 't': turn}}) AS fs FROM t
      WHERE tier = '{tier}' AND role = '{role}' AND {_sql_any('lower(outcome)', words)}
      GROUP BY company, content),
r AS (SELECT company, content AS text, ROW_NUMBER() OVER (PARTITION BY company ORDER BY fs) AS rank FROM f)
SELECT company, CAST(rank AS INT) AS rank, text FROM r WHERE rank <= 20
"""


@register("A12_failure_triggers", _distinct_sql("user", S.FAILURE_OUTCOME_WORDS))
def a12_failure_triggers(t):
    """A-12 first 20 distinct user messages of bad-outcome conversations."""
    return I.failure_triggers(_tiered(t)).withColumn("rank", F.col("rank").cast("int"))


@register("A13_successful_resolutions", _distinct_sql("assistant", S.SUCCESS_OUTCOME_WORDS))
def a13_successful_resolutions(t):
    """A-13 first 20 distinct assistant messages of good-outcome conversations."""
    return I.successful_resolutions(_tiered(t)).withColumn("rank", F.col("rank").cast("int"))


def _tone_sql(tones):
    case = "CASE " + " ".join(f"WHEN {_sql_any('low', kws)} THEN '{name}'" for name, kws in tones.items()) \
        + " ELSE 'neutral' END"
    from ..functions.numeric import py_round_sql
    pct = py_round_sql("n / CAST(SUM(n) OVER (PARTITION BY company) AS DOUBLE) * 100", 1)
    return _TIER + f""",
m AS (SELECT company, lower(content) AS low FROM t WHERE tier IN ('HIGH', 'MEDIUM') AND role = 'user'),
g AS (SELECT company, {case} AS tone, COUNT(*) AS n FROM m GROUP BY ALL),
p AS (SELECT company, tone, {pct} AS pct FROM g)
SELECT * FROM p
UNION ALL
SELECT DISTINCT company, 'neutral' AS tone, CAST(100.0 AS DOUBLE) AS pct FROM conv
WHERE company NOT IN (SELECT company FROM p)
"""


@register("A14_emotional_tone", _tone_sql(PP.TEST_TONES))
def a14_emotional_tone(t):
    """A-14 tone shares per company in percent (test tone words, Python rounding)."""
    conv = FX.conv(t)
    return I.emotional_tone(I.tier_messages(conv), PP.TEST_TONES, companies=conv)


@register("A15_avg_message_length", _TIER + """
SELECT company, CAST(TRUNC(SUM(length(content)) / CAST(COUNT(*) AS DOUBLE)) AS BIGINT) AS avg_message_length
FROM t WHERE role = 'user' GROUP BY company
""")
def a15_avg_message_length(t):
    """A-15 mean user message length (all tiers), truncated."""
    return I.avg_message_length(_tiered(t))


def _hint_sql(groups):
    parts = []
    for group in groups:
        case = "CASE " + " ".join(f"WHEN {_sql_any('low', ws)} THEN '{label}'" for label, ws in group) + " END"
        parts.append(case)
    return _TIER + f""",
m AS (SELECT company, conv_id, turn, concat_ws('_', {', '.join(parts)}) AS hint
      FROM (SELECT *, lower(content) AS low FROM t WHERE tier = 'HIGH' AND role = 'user') x),
g AS (SELECT company, hint, COUNT(*) AS n, min({{'c': conv_id, 't': turn}}) AS fs FROM m WHERE hint <> '' GROUP BY ALL),
r AS (SELECT company, hint, n, ROW_NUMBER() OVER (PARTITION BY company ORDER BY n DESC, fs) AS rank FROM g)
SELECT company, CAST(rank AS INT) AS rank, hint, n FROM r WHERE rank <= 10
"""


@register("A16_persona_hints", _hint_sql(S.PERSONA_HINT_GROUPS))
def a16_persona_hints(t):
    """A-16 top-10 persona hints per company (reference hint words)."""
    return I.persona_hints(_tiered(t)).withColumn("rank", F.col("rank").cast("int"))


def _insights_sql():
    def listed(name, column, field):
        return (f"SELECT company, string_agg({column}, '|' ORDER BY rank) AS {field} FROM ({QUERIES[name].sql.strip()}) x GROUP BY company")
    parts = {"voc": listed("A09_vocabulary", "word", "user_vocabulary"), "top": listed("A10_topics", "topic", "top_issue_categories"),
             "lang": f"SELECT company, patterns AS dominant_language_patterns FROM ({QUERIES['A11_language_patterns'].sql.strip()}) x",
             "trig": listed("A12_failure_triggers", "text", "failure_triggers"),
             "res": listed("A13_successful_resolutions", "text", "successful_resolutions"),
             "tone": "SELECT company, string_agg(tone || '=' || CAST(pct AS VARCHAR), '|' ORDER BY tone) AS emotional_tone_distribution "
                     f"FROM ({QUERIES['A14_emotional_tone'].sql.strip()}) x GROUP BY company",
             "len": QUERIES["A15_avg_message_length"].sql.strip(), "hint": listed("A16_persona_hints", "hint", "extracted_personas")}
    head = ",\n".join(f"{name}_part AS ({body})" for name, body in parts.items())
    joins = " ".join(f"LEFT JOIN {name}_part USING (company)" for name in parts)
    return f"""
WITH {head},
companies AS (SELECT company, COUNT(*) AS total_conversations_analyzed FROM conv GROUP BY company)
SELECT * FROM companies {joins}
"""


@register("A17_conversation_insights", _insights_sql())
def a17_insights(t):
    """A-17 one insight row per company (its lists and shares as text, joined by ``|``)."""
    found = I.insights(FX.conv(t), taxonomy=PP.TEST_TOPICS, markers=PP.TEST_INFORMAL_MARKERS, tones=PP.TEST_TONES)
    shares = F.transform(F.array_sort(F.map_entries("emotional_tone_distribution")),
                         lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    lists = ("user_vocabulary", "top_issue_categories", "failure_triggers", "successful_resolutions", "extracted_personas")
    return (found.withColumns({c: F.array_join(c, "|") for c in lists})
            .withColumn("dominant_language_patterns", F.array_join("dominant_language_patterns", ","))
            .withColumn("emotional_tone_distribution", F.array_join(shares, "|")))
