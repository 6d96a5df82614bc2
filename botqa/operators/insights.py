"""Conversation insights per company (P-06, A-09..A-17).

Input: messages ``(company, conv_id, turn, role, content, outcome)``.  The
message order of a company is ``(conv_id, turn)``; "first seen" tie-breaks use
that order (plus the word position inside a message where it matters).

Scale notes: every extraction is a hash aggregate keyed by company (plus word
/ topic / tone), with map-side partial aggregation, so a company holding a
third of all messages still spreads over all map tasks.  Top-k steps use
``row_number() <= k`` over the *aggregated* rows; Spark adds a partial
WindowGroupLimit before that shuffle, so at most k rows per company leave
each map task.  Keyword dictionaries are compiled into column expressions
(no join against a keyword table).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.numeric import py_round
from ..functions.text import contains_any, count_occurrences, py_split_words

ORDER = ["conv_id", "turn"]


def tier_messages(conv: DataFrame, min_chars: int = S.MIN_CONTENT_CHARS_EXCLUSIVE) -> DataFrame:
    """P-06: drop empty content; HIGH = long (> 20 chars) with an outcome,
    MEDIUM = long without outcome, LOW = the rest."""
    long_ = F.length("content") > min_chars
    has_outcome = F.col("outcome").isNotNull() & (F.length("outcome") > 0)
    return (conv.where(F.col("content").isNotNull() & (F.col("content") != ""))
                .withColumn("tier", F.when(has_outcome & long_, "HIGH")
                                     .when(long_, "MEDIUM").otherwise("LOW")))


def _first(cols: Sequence[str]) -> Column:
    return F.min(F.struct(*[F.col(c) for c in cols]))


def _topk(df: DataFrame, k: int, order: list[Column], key: str = "company") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vocabulary_words(content: str, stop_words: Sequence[str], punctuation: str = S.VOCAB_PUNCTUATION) -> Column:
    cleaned = F.translate(F.lower(content), punctuation, " " * len(punctuation))
    return F.filter(py_split_words(cleaned), lambda w: (F.length(w) > 2) & ~w.isin(list(stop_words)))


def vocabulary(tiered: DataFrame, stop_words: Sequence[str] = tuple(S.STOP_WORDS),
               k: int = S.VOCAB_TOP_K, punctuation: str = S.VOCAB_PUNCTUATION) -> DataFrame:
    """A-09: top-k user words (lower, punctuation -> space, stop words and
    words of <= 2 chars dropped), ties by first occurrence."""
    user = tiered.where(F.col("role") == "user")
    words = user.select("company", *ORDER, F.posexplode(_vocabulary_words("content", stop_words, punctuation)).alias("pos", "word"))
    g = words.groupBy("company", "word").agg(F.count(F.lit(1)).alias("n"),
                                             _first([*ORDER, "pos"]).alias("_first"))
    return _topk(g, k, [F.desc("n"), F.col("_first")]).select("company", "rank", "word", "n")


def _topic_counts(content: str, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """Array of (topic_ord, topic, n): keyword occurrences of each topic in a message."""
    low, per_topic = F.lower(content), []
    for i, (topic, kws) in enumerate(taxonomy.items()):
        n = sum((count_occurrences(low, kw) for kw in kws), F.lit(0).cast("bigint"))
        per_topic.append(F.struct(F.lit(i).alias("topic_ord"), F.lit(topic).alias("topic"), n.cast("bigint").alias("n")))
    return F.array(*per_topic)


def topics(tiered: DataFrame, taxonomy: Mapping[str, Sequence[str]] = S.TOPIC_KEYWORDS) -> DataFrame:
    """A-10: keyword occurrences per topic over HIGH+MEDIUM user messages;
    topics with hits, by count desc then taxonomy order.  Counts are
    non-overlapping substring counts per message (a spaced keyword that
    would only match across two joined messages is not counted)."""
    user = tiered.where(F.col("tier").isin("HIGH", "MEDIUM") & (F.col("role") == "user"))
    ex = user.select("company", F.explode(_topic_counts("content", taxonomy)).alias("t")).select("company", "t.*")
    g = ex.groupBy("company", "topic_ord", "topic").agg(F.sum("n").cast("bigint").alias("n"))
    g = g.where(F.col("n") > 0)
    w = Window.partitionBy("company").orderBy(F.desc("n"), "topic_ord")
    return g.withColumn("rank", F.row_number().over(w)).select("company", "rank", "topic", "n")


def language_patterns(tiered: DataFrame, markers: Sequence[str] = tuple(S.INFORMAL_MARKERS)) -> DataFrame:
    """A-11: length class, formality, caps, non-ASCII and punctuation labels
    over HIGH+MEDIUM user messages of each company.

    Formality counts how many *distinct* markers occur in the user texts
    joined by a space.  A marker ending in a space also matches a message
    that ends with the rest of the marker when another message follows it;
    that case is computed exactly from the flag of the last message.
    """
    user = tiered.where(F.col("tier").isin("HIGH", "MEDIUM") & (F.col("role") == "user"))
    low = F.lower("content")
    length = F.length("content")
    upper = length - F.length(F.regexp_replace("content", r"\p{Lu}", ""))
    bangs = count_occurrences("content", "!") + count_occurrences("content", "?")
    aggs = [F.count(F.lit(1)).alias("n_msgs"), F.avg(length).alias("avg_len"),
            F.count_if(upper > length * 0.4).alias("caps_msgs"),
            F.count_if(F.col("content").rlike(r"[^\x00-\x7F]")).alias("non_ascii_msgs"),
            F.count_if(bangs > 2).alias("punct_msgs")]
    for i, m in enumerate(markers):
        inside = F.max(F.contains(low, F.lit(m)).cast("int"))
        if m.endswith(" ") and m.strip() and " " not in m[:-1]:
            stem = m[:-1]
            ends = F.endswith(low, F.lit(stem))
            # messages ending with the stem, minus the last message if it does
            across = (F.count_if(ends)
                      - F.max_by(ends.cast("int"), F.struct(*[F.col(c) for c in ORDER]))) > 0
            hit = (inside == 1) | across
        else:
            hit = inside == 1
        aggs.append(hit.cast("int").alias(f"_m{i}"))
    g = user.groupBy("company").agg(*aggs)
    informal = sum((F.col(f"_m{i}") for i in range(len(markers))), F.lit(0)) if markers else F.lit(0)
    n = F.col("n_msgs")
    avg = F.col("avg_len")
    length_cls = (F.when(avg < 30, "very_short_messages").when(avg < 80, "short_messages")
                   .when(avg < 200, "medium_length_messages").otherwise("long_detailed_messages"))
    formality = (F.when(informal > n * 0.3, "informal_language")
                  .when(informal < n * 0.1, "formal_language").otherwise("mixed_formality"))
    caps = F.when(F.col("caps_msgs") > n * 0.2, "frequent_caps_usage")
    emoji = (F.when(F.col("non_ascii_msgs") > n * 0.3, "heavy_emoji_usage")
              .when(F.col("non_ascii_msgs") > n * 0.1, "occasional_emoji_usage"))
    punct = F.when(F.col("punct_msgs") > n * 0.2, "heavy_punctuation")
    return g.select("company", "n_msgs", informal.cast("bigint").alias("informal_markers"),
                    F.concat_ws(",", length_cls, formality, caps, emoji, punct).alias("patterns"))


def _ordered_distinct(df: DataFrame, k: int) -> DataFrame:
    g = df.groupBy("company", "content").agg(_first(ORDER).alias("_first"))
    return _topk(g, k, [F.col("_first")]).select("company", "rank", F.col("content").alias("text"))


def failure_trigger_messages(tiered: DataFrame,
                             words: Sequence[str] = tuple(S.FAILURE_OUTCOME_WORDS)) -> DataFrame:
    """HIGH-tier user messages of conversations with a bad outcome."""
    return tiered.where((F.col("tier") == "HIGH") & (F.col("role") == "user")
                        & contains_any(F.lower("outcome"), words))


def failure_triggers(tiered: DataFrame, words: Sequence[str] = tuple(S.FAILURE_OUTCOME_WORDS),
                     k: int = S.TRIGGERS_TOP_K) -> DataFrame:
    """A-12: HIGH user messages of conversations with a bad outcome; ordered distinct, first k."""
    return _ordered_distinct(failure_trigger_messages(tiered, words), k)


def failure_trigger_counts(tiered: DataFrame) -> DataFrame:
    """Number of distinct failure triggers per company (a plain aggregate: only
    its emptiness matters to the scenario mix, P-24)."""
    return (failure_trigger_messages(tiered).groupBy("company")
            .agg(F.count_distinct("content").alias("n_triggers")))


def successful_resolutions(tiered: DataFrame, words: Sequence[str] = tuple(S.SUCCESS_OUTCOME_WORDS),
                           k: int = S.TRIGGERS_TOP_K) -> DataFrame:
    """A-13: HIGH assistant messages of conversations with a good outcome; ordered distinct, first k."""
    f = tiered.where((F.col("tier") == "HIGH") & (F.col("role") == "assistant")
                     & contains_any(F.lower("outcome"), words))
    return _ordered_distinct(f, k)


def _tone(content: str, tones: Mapping[str, Sequence[str]]) -> Column:
    tone = F.lit("neutral")
    for name, kws in reversed(list(tones.items())):
        tone = F.when(contains_any(F.lower(content), kws), F.lit(name)).otherwise(tone)
    return tone


def emotional_tone(tiered: DataFrame, tones: Mapping[str, Sequence[str]] = S.TONE_KEYWORDS,
                   companies: DataFrame | None = None) -> DataFrame:
    """A-14: share of HIGH+MEDIUM user messages per tone (first matching tone in
    order, else neutral), in percent to 1 dp; zero tones dropped; a company
    without such messages gets neutral 100."""
    user = tiered.where(F.col("tier").isin("HIGH", "MEDIUM") & (F.col("role") == "user"))
    g = user.groupBy("company", _tone("content", tones).alias("tone")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("company")
    out = g.select("company", "tone", py_round(F.col("n") / F.sum("n").over(w) * 100, 1).alias("pct"))
    if companies is not None:
        empty = (companies.select("company").distinct()
                 .join(out.select("company").distinct(), "company", "left_anti")
                 .select("company", F.lit("neutral").alias("tone"), F.lit(100.0).alias("pct")))
        out = out.unionByName(empty)
    return out


def avg_message_length(tiered: DataFrame) -> DataFrame:
    """A-15: mean user message length over all tiers, truncated to int."""
    user = tiered.where(F.col("role") == "user")
    return user.groupBy("company").agg(
        (F.sum(F.length("content")) / F.count(F.lit(1))).cast("bigint").alias("avg_message_length"))


def persona_hint(content: Column, groups=S.PERSONA_HINT_GROUPS) -> Column:
    low = F.lower(content)
    parts = []
    for group in groups:
        expr = None
        for label, words in reversed(group):
            expr = F.when(contains_any(low, words), F.lit(label)) if expr is None else \
                F.when(contains_any(low, words), F.lit(label)).otherwise(expr)
        parts.append(expr)
    return F.concat_ws("_", *parts)


def persona_hints(tiered: DataFrame, groups=S.PERSONA_HINT_GROUPS,
                  k: int = S.PERSONA_HINTS_TOP_K) -> DataFrame:
    """A-16: hint per HIGH user message (age, style, mood, business parts
    joined by ``_``), top k by count, ties by first seen."""
    user = tiered.where((F.col("tier") == "HIGH") & (F.col("role") == "user"))
    h = user.select("company", *ORDER, persona_hint(F.col("content"), groups).alias("hint"))
    h = h.where(F.col("hint") != "")
    g = h.groupBy("company", "hint").agg(F.count(F.lit(1)).alias("n"), _first(ORDER).alias("_first"))
    return _topk(g, k, [F.desc("n"), F.col("_first")]).select("company", "rank", "hint", "n")


def insights(conv: DataFrame, *, stop_words=tuple(S.STOP_WORDS), taxonomy=S.TOPIC_KEYWORDS,
             markers=tuple(S.INFORMAL_MARKERS), tones=S.TONE_KEYWORDS,
             groups=S.PERSONA_HINT_GROUPS) -> DataFrame:
    """A-17: one insight row per company with the extractions A-09..A-16.

    The ranked lists and the tone shares come from one pass: a message gives
    (kind, value, n) entries, one aggregate counts them and one window ranks
    them within (company, kind).  Lists are ordered by rank and bounded by
    their top-k; a list without entries is null.
    """
    t = tier_messages(conv)
    user, high = F.col("role") == "user", F.col("tier") == "HIGH"
    told = user & F.col("tier").isin("HIGH", "MEDIUM")
    outcome, hint = F.lower("outcome"), persona_hint(F.col("content"), groups)

    def entry(kind, value, n=F.lit(1), ord_=F.lit(0), pos=F.lit(0)):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), n.cast("bigint").alias("n"),
                        ord_.alias("ord"), pos.alias("pos"))

    entries = F.flatten(F.array_compact(F.array(
        F.when(user, F.transform(_vocabulary_words("content", stop_words), lambda w, i: entry("word", w, pos=i))),
        F.when(told, F.transform(F.filter(_topic_counts("content", taxonomy), lambda x: x["n"] > 0),
                                 lambda x: entry("topic", x["topic"], x["n"], x["topic_ord"]))),
        F.when(told, F.array(entry("tone", _tone("content", tones)))),
        F.when(user & high & contains_any(outcome, S.FAILURE_OUTCOME_WORDS), F.array(entry("trigger", F.col("content")))),
        F.when((F.col("role") == "assistant") & high & contains_any(outcome, S.SUCCESS_OUTCOME_WORDS),
               F.array(entry("resolution", F.col("content")))),
        F.when(user & high & (hint != ""), F.array(entry("hint", hint))))))
    counted = (t.select("company", *ORDER, F.explode(entries).alias("e"))
               .groupBy("company", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
               .agg(F.sum("e.n").alias("n"), F.min(F.struct("e.ord", *ORDER, "e.pos")).alias("_first")))

    limits = {"word": S.VOCAB_TOP_K, "trigger": S.TRIGGERS_TOP_K, "resolution": S.TRIGGERS_TOP_K,
              "hint": S.PERSONA_HINTS_TOP_K}
    most = max(*limits.values(), len(taxonomy), len(tones) + 1)  # topics and tones are never cut
    limit = F.lit(most)
    for kind, k in limits.items():
        limit = F.when(F.col("kind") == kind, k).otherwise(limit)
    by_count = F.when(F.col("kind").isin("trigger", "resolution"), F.lit(0)).otherwise(-F.col("n"))
    w = Window.partitionBy("company", "kind").orderBy(by_count, "_first")
    top = (counted.withColumn("rank", F.row_number().over(w))
           .where((F.col("rank") <= most) & (F.col("rank") <= limit)))

    def listed(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "value", "n")))).alias(kind)

    lists = top.groupBy("company").agg(*[listed(k) for k in ("word", "topic", "tone", *list(limits)[1:])])

    def values(kind):
        return F.when(F.size(kind) > 0, F.transform(kind, lambda x: x["value"]))

    told_n = F.aggregate("tone", F.lit(0).cast("bigint"), lambda n, x: n + x["n"])
    shares = F.map_from_entries(F.transform("tone", lambda x: F.struct(
        x["value"].alias("tone"), py_round(x["n"] / told_n * 100, 1).alias("pct"))))
    said = user & (F.col("content") != "")
    companies = conv.groupBy("company").agg(
        F.count(F.lit(1)).alias("total_conversations_analyzed"),
        F.try_divide(F.sum(F.when(said, F.length("content"))), F.count_if(said)).cast("bigint").alias("avg_message_length"))
    lang = language_patterns(t, markers).select("company", F.split("patterns", ",").alias("dominant_language_patterns"))
    return (companies.join(lists, "company", "left").join(lang, "company", "left").select(
        "company", "total_conversations_analyzed", values("word").alias("user_vocabulary"),
        values("topic").alias("top_issue_categories"), "dominant_language_patterns",
        values("trigger").alias("failure_triggers"), values("resolution").alias("successful_resolutions"),
        F.when(F.size("tone") > 0, shares).otherwise(F.create_map(F.lit("neutral"), F.lit(100.0)))
        .alias("emotional_tone_distribution"),
        "avg_message_length", values("hint").alias("extracted_personas")))
