"""Knowledge base per company (U-set-1, J-07, K-04, P-07, P-31..P-33, A-24..A-26).

Documents are rows ``(kb, doc_id, content, source, source_type, is_synthetic,
doc_ord)``; every step is a projection, an ``explode`` over a fixed list or an
aggregate keyed by the knowledge base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import cut_lineage

# FIXED VALUES — knowledge base
CHALLENGE_TYPES = ["multi_section", "out_of_scope", "ambiguous", "contradictory"]
VARIATIONS_PER_DOC = 2
MAX_DOCS_PER_SOURCE = 10
MAX_SCRATCH_DOCS = 5
GROUNDED_COUNT = 200
DOMAIN_TOPICS = {
    "general": ["company policies and procedures", "product documentation", "frequently asked questions",
                "technical specifications", "user guide"],
    "legal": ["service agreement terms", "privacy policy", "liability clauses",
              "jurisdiction and governing law", "dispute resolution procedures"],
    "medical": ["patient intake procedures", "medication guidelines", "treatment protocols",
                "emergency procedures", "insurance and billing"],
    "finance": ["account terms and conditions", "fee schedule", "investment risk disclosures",
                "transaction policies", "compliance requirements"],
    "retail": ["return and refund policy", "shipping and delivery information", "product warranty terms",
               "loyalty program details", "payment methods accepted"],
}

DOC_COLUMNS = ["kb", "doc_id", "content", "source", "source_type", "is_synthetic", "doc_ord"]


def split_real_synthetic(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-07: real and synthetic documents."""
    return docs.where(~F.col("is_synthetic")), docs.where(F.col("is_synthetic"))


def build_knowledge_base(*sources: DataFrame, scratch: DataFrame | None = None,
                         variations: DataFrame | None = None) -> DataFrame:
    """U-set-1: union of the document sources; scratch documents only for
    knowledge bases without any real document (anti-join per kb); variations
    on top.  Missing columns are filled with nulls."""
    kb = None
    for s in sources:
        kb = s if kb is None else kb.unionByName(s, allowMissingColumns=True)
    if scratch is not None:
        has_real = kb.where(~F.col("is_synthetic")).select("kb").distinct()
        kb = kb.unionByName(scratch.join(has_real, "kb", "left_anti"), allowMissingColumns=True)
    if variations is not None:
        kb = kb.unionByName(variations, allowMissingColumns=True)
    return kb


def plan_variations(docs: DataFrame, challenge_types: Sequence[str] = tuple(CHALLENGE_TYPES),
                    per_doc: int = VARIATIONS_PER_DOC, max_docs: int = MAX_DOCS_PER_SOURCE,
                    keep: Sequence[str] = ()) -> DataFrame:
    """J-07: the first ``max_docs`` real documents of each kb x the first
    ``per_doc`` challenge types.  The challenge list is a literal array on
    each row (explode), not a joined table; ``keep`` names further columns."""
    real = docs.where(~F.col("is_synthetic"))
    w = Window.partitionBy("kb").orderBy("doc_ord")
    first = real.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_docs)
    types = F.array(*[F.lit(c) for c in list(challenge_types)[:per_doc]])
    return first.select("kb", "doc_id", "source", *keep, F.posexplode(types).alias("challenge_ord", "challenge_type"))


def scratch_requests(docs: DataFrame, settings: DataFrame, max_docs: int = MAX_DOCS_PER_SOURCE) -> DataFrame:
    """One request per topic of each kb that has no real document and allows
    documents from scratch.  ``settings`` holds a row per kb: ``domain``,
    ``topics`` (null or empty: the domain's defaults) and ``synthetic_from_scratch``."""
    count = min(MAX_SCRATCH_DOCS, max_docs)
    real = docs.where(~F.col("is_synthetic")).select("kb").distinct()
    bare = settings.where("synthetic_from_scratch").join(real, "kb", "left_anti")
    given = bare.where(F.size("topics") > 0).select(
        "kb", "domain", F.posexplode(F.slice("topics", 1, count)).alias("topic_no", "topic"))
    default = default_topics(bare.where(~F.coalesce(F.size("topics") > 0, F.lit(False))).select("kb", "domain"), count=count)
    name = F.concat(F.lit("synthetic_scratch_"), F.substring(F.replace("topic", F.lit(" "), F.lit("_")), 1, 30))
    return given.unionByName(default).withColumn("source", name)


def scratch_documents(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents from the replies ``(kb, topic_no, content)`` to scratch requests;
    a request without a reply gives none.  Ordered by topic."""
    answered = requests.join(replies.where("content is not null"), ["kb", "topic_no"])
    return answered.select(
        "kb", F.concat("source", F.lit("_"), F.col("topic_no").cast("string")).alias("doc_id"), py_strip("content").alias("content"),
        "source", F.col("topic").alias("section"), F.lit("SYNTHETIC_CHALLENGING").alias("source_type"), F.lit(True).alias("is_synthetic"),
        F.col("topic_no").cast("bigint").alias("doc_ord"), F.lit("from_scratch").alias("challenge_type"),
        F.lit(None).cast("string").alias("based_on"))


def variation_requests(docs: DataFrame, scratch: DataFrame, settings: DataFrame, **options) -> DataFrame:
    """J-07 over the documents that a kb builds on: its real ones, else those
    made from scratch; only where ``settings.enable_synthetic``."""
    columns = ["kb", "doc_id", "source", "section", "doc_ord"]
    base = docs.where(~F.col("is_synthetic")).select(*columns).unionByName(scratch.select(*columns))
    base = base.join(settings.where("enable_synthetic").select("kb"), "kb").withColumn("is_synthetic", F.lit(False))
    return plan_variations(base, keep=["section"], **options)


def variation_documents(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents from the replies ``(kb, doc_id, challenge_type, content)`` to
    variation requests; a request without a reply gives none."""
    answered = requests.join(replies.where("content is not null"), ["kb", "doc_id", "challenge_type"])
    kind = F.concat(F.lit("synthetic_"), F.col("challenge_type"), F.lit("_"))
    return answered.select(
        "kb", F.concat(kind, "doc_id").alias("doc_id"), py_strip("content").alias("content"),
        F.concat(kind, F.substring("doc_id", 1, 8)).alias("source"),
        F.concat(F.coalesce("section", F.lit("")), F.lit(" ["), F.col("challenge_type"), F.lit("]")).alias("section"),
        F.lit("SYNTHETIC_CHALLENGING").alias("source_type"), F.lit(True).alias("is_synthetic"),
        "challenge_type", F.col("source").alias("based_on"))


def assemble(docs: DataFrame, settings: DataFrame, scratch_replies: DataFrame, variation_replies: DataFrame,
             **options) -> DataFrame:
    """U-set-1, the whole chain: the documents of all sources, documents from
    scratch for kbs that have no real one, variations on top of either.  The
    replies of both request steps are tables, as of any model call here."""
    scratch = cut_lineage(scratch_documents(scratch_requests(docs, settings), scratch_replies))  # used twice, a few rows per bare kb
    variations = variation_documents(variation_requests(docs, scratch, settings, **options), variation_replies)
    return build_knowledge_base(docs, scratch, variations=variations)  # scratch holds kbs without real documents only


def kb_status(settings: DataFrame, kb: DataFrame) -> DataFrame:
    """What each configured kb is built on: ``real``, ``scratch`` or ``none`` (a
    warning: nothing real was found and nothing may or could be made)."""
    made = F.col("challenge_type") == "from_scratch"
    found = kb.groupBy("kb").agg(F.count_if(~F.col("is_synthetic")).alias("real"), F.count_if(made).alias("scratch"),
                                 F.count_if(F.col("based_on").isNotNull()).alias("variations"), F.count("*").alias("documents"))
    n = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("documents", "real", "scratch", "variations")]
    basis = F.when(F.col("real") > 0, "real").when(F.col("scratch") > 0, "scratch").otherwise("none")
    return settings.select("kb").join(found, "kb", "left").select("kb", basis.alias("basis"), *n)


def grounded_slots(kb_docs: DataFrame, count: int = GROUNDED_COUNT) -> DataFrame:
    """K-04: ``max(1, count // docs)`` question slots per document, then the
    first ``count`` overall (document order).  Every document has a slot, so
    only the first ``count`` documents of a kb can reach the cut: they are
    taken first (partial limit before the shuffle), and the counts are joined
    to those rows instead of the corpus."""
    n_docs = kb_docs.groupBy("kb").agg(F.count(F.lit(1)).alias("_docs"))
    per = F.greatest(F.lit(1), F.floor(F.lit(count) / F.greatest(F.lit(1), F.col("_docs")))).cast("int")
    first = (kb_docs.select("kb", "doc_id", "doc_ord", "is_synthetic")
             .withColumn("_rn", F.row_number().over(Window.partitionBy("kb").orderBy("doc_ord")))
             .where(F.col("_rn") <= count).drop("_rn"))
    s = first.join(n_docs.select("kb", per.alias("_per")), "kb").select(
        "kb", "doc_id", "doc_ord", "is_synthetic", F.explode(F.sequence(F.lit(0), F.col("_per") - 1)).alias("q"))
    w = Window.partitionBy("kb").orderBy("doc_ord", "q")
    return s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).drop("_rn")


def kb_totals(docs: DataFrame) -> DataFrame:
    """A-24: documents, real, synthetic and characters per kb."""
    return docs.groupBy("kb").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("is_synthetic")).alias("real"),
        F.count_if(F.col("is_synthetic")).alias("synthetic"),
        F.sum(F.length("content")).cast("bigint").alias("total_chars"))


def kb_sources(docs: DataFrame) -> DataFrame:
    """A-25: documents per (kb, source type)."""
    return docs.groupBy("kb", "source_type").agg(F.count(F.lit(1)).alias("n"))


def grounded_counts(slots: DataFrame) -> DataFrame:
    """A-26: grounded questions from real vs synthetic documents per kb."""
    return slots.groupBy("kb").agg(F.count(F.lit(1)).alias("grounded"),
                                   F.count_if(~F.col("is_synthetic")).alias("from_real"),
                                   F.count_if(F.col("is_synthetic")).alias("from_synthetic"))


def line_classes(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """P-31: each stripped line as blank / heading (all upper case, starts
    with SECTION, or ends with ':' and < 50 chars) / normal."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"))
    line = py_strip(F.col("raw"))
    is_upper = (F.upper(line) == line) & (F.lower(line) != line)
    cls = (F.when(line == "", "blank")
            .when(is_upper | F.startswith(line, F.lit("SECTION"))
                  | (F.endswith(line, F.lit(":")) & (F.length(line) < 50)), "heading")
            .otherwise("normal"))
    return lines.select("doc_id", "line_no", cls.alias("line_class"))


def paragraphs(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """P-32: paragraphs split on a blank line, stripped, empties dropped."""
    p = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n\n")).alias("para_no", "raw"))
    return p.select("doc_id", "para_no", py_strip("raw").alias("paragraph")).where(F.col("paragraph") != "")


def default_topics(kbs: DataFrame, domain_col: str = "domain", count: int = 5) -> DataFrame:
    """P-33: default topics of the kb's domain (unknown -> general), first ``count``."""
    m = F.create_map(*[x for d, ts in DOMAIN_TOPICS.items()
                       for x in (F.lit(d), F.array(*[F.lit(t) for t in ts]))])
    topics = F.coalesce(F.try_element_at(m, F.lower(F.col(domain_col))), F.try_element_at(m, F.lit("general")))
    return kbs.select("kb", domain_col, F.posexplode(F.slice(topics, 1, count)).alias("topic_no", "topic"))
