"""Registered queries: knowledge base and pages (SRC-08..SRC-11, U-set-1, J-07, K-04,
P-07, P-31..P-33, A-24..A-26)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators import kb as KB
from ..session import cut_lineage
from ..sources import fixtures as FX
from ..sources import pages as PG
from .registry import QUERIES, register

_KB = """
WITH d AS (SELECT source AS kb, doc_id, CAST(doc_id AS BIGINT) AS doc_ord, content, source_type, is_synthetic FROM kb_docs)
"""


def _docs(t):
    return FX.kb_docs(t).select(F.col("source").alias("kb"), "doc_id", F.col("doc_id").cast("bigint").alias("doc_ord"),
                                "content", "source", "source_type", "is_synthetic")


@register("A24_kb_totals", _KB + """
SELECT kb, COUNT(*) AS documents, CAST(SUM(CASE WHEN NOT is_synthetic THEN 1 ELSE 0 END) AS BIGINT) AS real,
       CAST(SUM(CASE WHEN is_synthetic THEN 1 ELSE 0 END) AS BIGINT) AS synthetic, CAST(SUM(length(content)) AS BIGINT) AS total_chars
FROM d GROUP BY kb
""")
def a24_totals(t):
    """A-24 documents, real, synthetic and characters per knowledge base."""
    return KB.kb_totals(_docs(t))


@register("A25_kb_sources", _KB + "SELECT kb, source_type, COUNT(*) AS n FROM d GROUP BY ALL")
def a25_sources(t):
    """A-25 documents per source type."""
    return KB.kb_sources(_docs(t))


@register("P07_real_synthetic", _KB + """
SELECT kb, is_synthetic, COUNT(*) AS n FROM d GROUP BY ALL
""")
def p07_split(t):
    """P-07 real / synthetic document split."""
    real, syn = KB.split_real_synthetic(_docs(t))
    return real.unionByName(syn).groupBy("kb", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("J07_variation_plan", _KB + """
SELECT kb, doc_id, c.challenge_ord, c.challenge_type FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY kb ORDER BY doc_ord) AS rn FROM d WHERE NOT is_synthetic) x
CROSS JOIN (SELECT 0 AS challenge_ord, 'multi_section' AS challenge_type UNION ALL SELECT 1, 'out_of_scope') c
WHERE rn <= 10
""")
def j07_variations(t):
    """J-07 first 10 real documents per kb x first 2 challenge types."""
    return KB.plan_variations(_docs(t)).select("kb", "doc_id", "challenge_ord", "challenge_type")


_SLOTS = _KB + """,
nd AS (SELECT kb, COUNT(*) AS n FROM d GROUP BY kb),
s AS (SELECT d.kb, d.doc_id, d.doc_ord, d.is_synthetic, unnest(generate_series(0, GREATEST(1, CAST(FLOOR(200 / GREATEST(1, nd.n)) AS BIGINT)) - 1)) AS q
      FROM d JOIN nd ON nd.kb = d.kb),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kb ORDER BY doc_ord, q) AS rn FROM s)
"""


@register("K04_grounded_slots", _SLOTS + "SELECT kb, doc_id, CAST(q AS INT) AS q FROM r WHERE rn <= 200")
def k04_slots(t):
    """K-04 grounded question slots per document, capped at 200 per kb."""
    return KB.grounded_slots(_docs(t)).select("kb", "doc_id", F.col("q").cast("int").alias("q"))


@register("A26_grounded_counts", _SLOTS + """
SELECT kb, COUNT(*) AS grounded, CAST(SUM(CASE WHEN NOT is_synthetic THEN 1 ELSE 0 END) AS BIGINT) AS from_real,
       CAST(SUM(CASE WHEN is_synthetic THEN 1 ELSE 0 END) AS BIGINT) AS from_synthetic
FROM r WHERE rn <= 200 GROUP BY kb
""")
def a26_grounded_counts(t):
    """A-26 grounded questions from real vs synthetic documents."""
    return KB.grounded_counts(KB.grounded_slots(_docs(t)))


@register("P31_line_classes", _KB + """
, l AS (SELECT doc_id, regexp_replace(unnest(string_split(content, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM d)
SELECT doc_id, CASE WHEN line = '' THEN 'blank'
                    WHEN (upper(line) = line AND lower(line) <> line) OR starts_with(line, 'SECTION')
                         OR (ends_with(line, ':') AND length(line) < 50) THEN 'heading' ELSE 'normal' END AS line_class,
       COUNT(*) AS n
FROM l GROUP BY ALL
""")
def p31_line_classes(t):
    """P-31 document lines by class (blank / heading / normal), counted per document."""
    return KB.line_classes(_docs(t)).groupBy("doc_id", "line_class").agg(F.count(F.lit(1)).alias("n"))


@register("P32_paragraphs", _KB + """
, p AS (SELECT doc_id, regexp_replace(unnest(string_split(content, chr(10) || chr(10))), '^\\s+|\\s+$', '', 'g') AS para FROM d)
SELECT doc_id, COUNT(*) AS paragraphs, CAST(SUM(length(para)) AS BIGINT) AS chars FROM p WHERE para <> '' GROUP BY doc_id
""")
def p32_paragraphs(t):
    """P-32 paragraphs (split on a blank line) per document."""
    p = KB.paragraphs(_docs(t))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"),
                                   F.sum(F.length("paragraph")).cast("bigint").alias("chars"))


@register("P33_default_topics", """
WITH k AS (SELECT DISTINCT source AS kb, CASE CAST(substr(source, 4) AS INT) % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'Legal'
           WHEN 2 THEN 'medical' WHEN 3 THEN 'finance' WHEN 4 THEN 'retail' ELSE 'gaming' END AS domain FROM documents),
t AS (SELECT * FROM (VALUES
  ('general', 0, 'company policies and procedures'), ('general', 1, 'product documentation'), ('general', 2, 'frequently asked questions'),
  ('legal', 0, 'service agreement terms'), ('legal', 1, 'privacy policy'), ('legal', 2, 'liability clauses'),
  ('medical', 0, 'patient intake procedures'), ('medical', 1, 'medication guidelines'), ('medical', 2, 'treatment protocols'),
  ('finance', 0, 'account terms and conditions'), ('finance', 1, 'fee schedule'), ('finance', 2, 'investment risk disclosures'),
  ('retail', 0, 'return and refund policy'), ('retail', 1, 'shipping and delivery information'), ('retail', 2, 'product warranty terms')
  ) v(domain, topic_no, topic))
SELECT k.kb, k.domain, t.topic_no, t.topic FROM k JOIN t ON t.domain = CASE WHEN lower(k.domain) IN ('general','legal','medical','finance','retail') THEN lower(k.domain) ELSE 'general' END
""")
def p33_topics(t):
    """P-33 default topics (first 3) of each kb's domain; unknown domain -> general."""
    k = F.substring("source", 4, 8).cast("int") % 6
    dom = (F.when(k == 0, "general").when(k == 1, "Legal").when(k == 2, "medical").when(k == 3, "finance")
            .when(k == 4, "retail").otherwise("gaming"))
    kbs = t.documents.select(F.col("source").alias("kb"), dom.alias("domain")).distinct()
    return KB.default_topics(kbs, count=3).select("kb", "domain", F.col("topic_no").cast("int").alias("topic_no"), "topic")


@register("SRC11_uploaded_documents", _KB + """
SELECT kb, COUNT(*) AS uploaded FROM d WHERE source_type = 'UPLOADED' GROUP BY kb
""")
def src11_uploaded(t):
    """SRC-11 uploaded documents per knowledge base."""
    return _docs(t).where(F.col("source_type") == "UPLOADED").groupBy("kb").agg(F.count(F.lit(1)).alias("uploaded"))


_SITES = """
WITH s AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
                  regexp_extract(url, '^(https?://[^/?#]+)', 1) || '//' AS base_url,
                  regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)?', 1) AS path
           FROM pages)
"""


def _sites(t):
    p = t.pages
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    return p.select(host.alias("site"), F.concat(host, F.lit("//")).alias("base_url"),
                    F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)?", 1).alias("path"))


@register("SRC09_site_urls", _SITES + """
SELECT site, path, regexp_replace(base_url, '/+$', '') || path AS url FROM s
""")
def src09_site_urls(t):
    """SRC-09 page URLs from a site base (trailing slashes stripped) and its paths."""
    return PG.site_urls(_sites(t).withColumn("paths", F.array("path")).drop("path"))


@register("SRC10_external_urls", """
WITH u AS (SELECT url FROM pages UNION ALL SELECT url || '#missing' FROM pages WHERE page_id % 10 = 0)
SELECT CASE WHEN p.url IS NULL THEN 'missing' ELSE 'found' END AS status, COUNT(*) AS n
FROM u LEFT JOIN pages p ON p.url = u.url GROUP BY ALL
""")
def src10_external(t):
    """SRC-10 listed URLs found among the fetched pages vs missing ones."""
    pages = t.pages
    urls = pages.select("url").unionByName(
        pages.where(F.col("page_id") % 10 == 0).select(F.concat("url", F.lit("#missing")).alias("url")))
    status = F.when(F.col("fetched"), "found").otherwise("missing").alias("status")
    return PG.fetch_listed(urls, pages).groupBy(status).agg(F.count(F.lit(1)).alias("n"))


@register("KB01_page_documents")
def kb01_page_documents(t):
    """SRC-08/U-02/S-01..S-05: documents extracted from every page (HTML parsed in Arrow batches)."""
    return PG.page_documents(t.pages).select("page_id", "source", "section", "content_length", "content")


@register("SRC08_page_outcomes")
def src08_page_outcomes(t):
    """SRC-08/S-04: pages by what became of them: document, short, no text, parser error."""
    return PG.page_outcome(PG.extract_pages(t.pages)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("USET1_knowledge_base")
def uset1_knowledge_base(t):
    """U-set-1: documents + scraped pages + planned variations, totals per kb."""
    docs = _docs(t)
    pages = PG.page_documents(t.pages).select(
        F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("kb"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("doc_id"),
        (F.col("page_id") + 1_000_000_000).alias("doc_ord"), "content", "source", "source_type", "is_synthetic")
    var = KB.plan_variations(docs).select(
        "kb", F.concat(F.lit("synthetic_"), F.col("challenge_type"), F.lit("_"), F.col("doc_id")).alias("doc_id"),
        F.lit(None).cast("bigint").alias("doc_ord"), F.lit(None).cast("string").alias("content"),
        F.concat(F.lit("synthetic_"), F.col("challenge_type"), F.lit("_"), F.col("doc_id")).alias("source"),
        F.lit("SYNTHETIC_CHALLENGING").alias("source_type"), F.lit(True).alias("is_synthetic"))
    kb = KB.build_knowledge_base(docs, pages, variations=var)
    return KB.kb_totals(kb)


# ------------------------------------------------------------------ prompts
from ..functions import prompts as P  # noqa: E402
from .q_prompt import render_sql  # noqa: E402


@register("PR14_grounded_prompts", _KB + f""",
nd AS (SELECT kb, COUNT(*) AS n FROM d GROUP BY kb)
SELECT d.kb, d.doc_id, {render_sql(P.GROUNDED_QA_PROMPT, content="substr(d.content, 1, 3000)",
                                   count="GREATEST(1, CAST(FLOOR(200 / GREATEST(1, nd.n)) AS BIGINT))")} AS prompt
FROM d JOIN nd ON nd.kb = d.kb
""")
def pr14_grounded_prompts(t):
    """PR-14: grounded-QA request per document (first 3000 chars, max(1, 200 // docs) questions)."""
    d = _docs(t)
    n = d.groupBy("kb").agg(F.count(F.lit(1)).alias("_n"))
    cnt = F.greatest(F.lit(1), F.floor(F.lit(200) / F.greatest(F.lit(1), F.col("_n")))).cast("bigint")
    j = d.select("kb", "doc_id", F.substring("content", 1, 3000).alias("content")).join(n, "kb")
    return j.select("kb", "doc_id", P.render(P.GROUNDED_QA_PROMPT, content=F.col("content"), count=cnt).alias("prompt"))


_DESC_SQL = "CASE challenge_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in P.CHALLENGE_DESCRIPTIONS.items()) + \
    f" ELSE '{P.DEFAULT_CHALLENGE_DESCRIPTION}' END"


@register("PR15_variation_prompts", _KB + f""",
v AS (SELECT kb, doc_id, content, c.challenge_type FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY kb ORDER BY doc_ord) AS rn FROM d WHERE NOT is_synthetic) x
      CROSS JOIN (SELECT 'multi_section' AS challenge_type UNION ALL SELECT 'out_of_scope') c WHERE rn <= 10)
SELECT kb, doc_id, challenge_type, {render_sql(P.VARIATION_PROMPT, content="substr(content, 1, 2000)",
                                               challenge_type="challenge_type", description=_DESC_SQL)} AS prompt
FROM v
""")
def pr15_variation_prompts(t):
    """PR-15: variation request per (document, challenge type) of the J-07 plan (first 2000 chars)."""
    d = _docs(t)
    plan = KB.plan_variations(d).join(d.select("kb", "doc_id", "content"), ["kb", "doc_id"])
    desc = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in P.CHALLENGE_DESCRIPTIONS.items() for x in kv]),
                                       F.col("challenge_type")), F.lit(P.DEFAULT_CHALLENGE_DESCRIPTION))
    return plan.select("kb", "doc_id", "challenge_type",
                       P.render(P.VARIATION_PROMPT, content=F.substring("content", 1, 2000),
                                challenge_type="challenge_type", description=desc).alias("prompt"))


@register("PR16_scratch_prompts", "WITH tp AS (" + QUERIES["P33_default_topics"].sql.strip() + f""")
SELECT kb, topic_no, {render_sql(P.SCRATCH_DOCUMENT_PROMPT, domain="domain", topic="topic",
                                 company_context="'Company: ' || kb || chr(10) || 'Industry: ' || domain || chr(10)")} AS prompt
FROM tp
""")
def pr16_scratch_prompts(t):
    """PR-16: scratch-document request per default topic of each kb's domain, with company context."""
    tp = QUERIES["P33_default_topics"].build(t)
    ctx = F.concat(F.lit("Company: "), F.col("kb"), F.lit("\nIndustry: "), F.col("domain"), F.lit("\n"))
    return tp.select("kb", "topic_no", P.render(P.SCRATCH_DOCUMENT_PROMPT, domain="domain", topic="topic",
                                                company_context=ctx).alias("prompt"))


# Knowledge bases of the chain: source and doc_id % 8, so that those of 3 and 7 hold synthetic documents alone.
# Replies are texts of the given documents; some requests have none.
_CHAIN = """
WITH d AS (SELECT source || '_' || CAST(doc_id % 8 AS VARCHAR) AS kb, CAST(doc_id AS VARCHAR) AS doc_id, text AS content, source, lang AS section,
                  CASE doc_id % 4 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'SCRAPED_COMPANY_SITE' WHEN 2 THEN 'SCRAPED_EXTERNAL' ELSE 'SYNTHETIC_CHALLENGING' END AS source_type,
                  doc_id % 4 = 3 AS is_synthetic, doc_id AS doc_ord FROM documents),
s AS (SELECT DISTINCT kb, CAST(right(kb, 1) AS INT) AS g, CASE WHEN kb LIKE 'src1%' THEN 'Legal' WHEN kb LIKE 'src2%' THEN 'gaming' ELSE 'retail' END AS domain FROM d),
bare AS (SELECT * FROM s WHERE g = 3 AND kb NOT IN (SELECT kb FROM d WHERE NOT is_synthetic)),
t AS (SELECT kb, v.topic_no, v.topic FROM bare JOIN (VALUES
  ('Legal', 0, 'service agreement terms'), ('Legal', 1, 'privacy policy'), ('Legal', 2, 'liability clauses'),
  ('Legal', 3, 'jurisdiction and governing law'), ('Legal', 4, 'dispute resolution procedures'),
  ('gaming', 0, 'company policies and procedures'), ('gaming', 1, 'product documentation'), ('gaming', 2, 'frequently asked questions'),
  ('gaming', 3, 'technical specifications'), ('gaming', 4, 'user guide'),
  ('retail', 0, 'gift cards'), ('retail', 1, 'opening hours of all our shops and stands')) v(domain, topic_no, topic) ON v.domain = bare.domain),
n AS (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY doc_ord) - 1 AS rn FROM d),
scratch AS (SELECT t.kb, 'synthetic_scratch_' || substr(replace(topic, ' ', '_'), 1, 30) AS source, topic_no, topic, n.content
            FROM t JOIN n ON n.kb = t.kb AND n.rn = t.topic_no WHERE n.content IS NOT NULL),
sd AS (SELECT kb, source || '_' || CAST(topic_no AS VARCHAR) AS doc_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content, source,
              topic AS section, CAST(topic_no AS BIGINT) AS doc_ord FROM scratch),
base AS (SELECT kb, doc_id, source, section, doc_ord, content FROM d WHERE NOT is_synthetic
         UNION ALL SELECT kb, doc_id, source, section, doc_ord, content FROM sd),
f AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY b.kb ORDER BY b.doc_ord) AS rn FROM base b JOIN s ON s.kb = b.kb WHERE s.g <> 1) x WHERE rn <= 10),
v AS (SELECT kb, 'synthetic_' || c || '_' || doc_id AS doc_id, c || ': ' || regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content,
             'synthetic_' || c || '_' || substr(doc_id, 1, 8) AS source, coalesce(section, '') || ' [' || c || ']' AS section, c AS challenge_type, source AS based_on
      FROM f, (VALUES ('multi_section'), ('out_of_scope')) k(c) WHERE content IS NOT NULL AND NOT (c = 'out_of_scope' AND length(content) % 3 = 0)),
kb_all AS (SELECT kb, doc_id, source, section, source_type, is_synthetic, NULL AS challenge_type, NULL AS based_on, content FROM d
  UNION ALL SELECT kb, doc_id, source, section, 'SYNTHETIC_CHALLENGING', true, 'from_scratch', NULL, content FROM sd
  UNION ALL SELECT kb, doc_id, source, section, 'SYNTHETIC_CHALLENGING', true, challenge_type, based_on, content FROM v)
"""


def _chain(t):
    """Documents, settings, and the replies to scratch and variation requests."""
    kb = F.concat("source", F.lit("_"), (F.col("doc_id") % 8).cast("string"))
    d = (t.documents.select("doc_id", "lang", kb.alias("kb")).withColumn("doc_id", F.col("doc_id").cast("string"))
         .join(FX.kb_docs(t), "doc_id"))
    docs = d.select("kb", "doc_id", "content", "source", F.col("lang").alias("section"), "source_type", "is_synthetic",
                    F.col("doc_id").cast("bigint").alias("doc_ord"))
    group = F.substring("kb", -1, 1).cast("int")
    domain = F.when(F.col("kb").startswith("src1"), "Legal").when(F.col("kb").startswith("src2"), "gaming").otherwise("retail")
    own = F.array(F.lit("gift cards"), F.lit("opening hours of all our shops and stands"))
    settings = cut_lineage(docs.select("kb").distinct()).select(
        "kb", domain.alias("domain"), F.when(domain == "retail", own).alias("topics"), (group == 3).alias("synthetic_from_scratch"),
        (group != 1).alias("enable_synthetic"))
    first = F.row_number().over(Window.partitionBy("kb").orderBy("doc_ord"))
    scratch_replies = (docs.withColumn("rn", first).where(F.col("rn") <= KB.MAX_SCRATCH_DOCS)
                       .select("kb", (F.col("rn") - 1).alias("topic_no"), "content"))
    scratch = cut_lineage(KB.scratch_documents(KB.scratch_requests(docs, settings), scratch_replies))
    challenge = F.explode(F.array(F.lit("multi_section"), F.lit("out_of_scope"))).alias("challenge_type")
    asked = docs.where(~F.col("is_synthetic")).select("kb", "doc_id", "content").unionByName(scratch.select("kb", "doc_id", "content"))
    variation_replies = (asked.select("kb", "doc_id", "content", challenge)
                         .where(~((F.col("challenge_type") == "out_of_scope") & (F.length("content") % 3 == 0)))
                         .withColumn("content", F.concat("challenge_type", F.lit(": "), py_strip("content"))))
    return docs, settings, scratch_replies, variation_replies


@register("USET1_source_chain", _CHAIN + """
SELECT kb, doc_id, source, section, source_type, is_synthetic, challenge_type, based_on, length(content) AS chars, md5(content) AS content_md5 FROM kb_all
""")
def uset1_source_chain(t):
    """U-set-1: documents of all sources, from scratch where a kb has no real one, variations on either."""
    return KB.assemble(*_chain(t)).select("kb", "doc_id", "source", "section", "source_type", "is_synthetic", "challenge_type", "based_on",
                                          F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("content_md5"))


@register("USET1_status", _CHAIN + """
SELECT s.kb, CASE WHEN count_if(NOT k.is_synthetic) > 0 THEN 'real' WHEN count_if(k.challenge_type = 'from_scratch') > 0 THEN 'scratch' ELSE 'none' END AS basis,
       COUNT(k.kb) AS documents, CAST(count_if(NOT k.is_synthetic) AS BIGINT) AS real, CAST(count_if(coalesce(k.challenge_type, '') = 'from_scratch') AS BIGINT) AS scratch,
       CAST(count_if(k.based_on IS NOT NULL) AS BIGINT) AS variations
FROM s LEFT JOIN kb_all k ON k.kb = s.kb GROUP BY s.kb
""")
def uset1_status(t):
    """U-set-1: what each knowledge base is built on, with the warning of those built on nothing."""
    docs, settings, *replies = _chain(t)
    return KB.kb_status(settings, KB.assemble(docs, settings, *replies))
