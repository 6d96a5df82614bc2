"""Registered queries of this subpackage: each applies one operator to its whole
table and returns its whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, divergence, fingerprints, mixing, quality, secrets, sharding, simhash, tokens, toxicity, warc
from .common import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``rows``."""
    text = F.col("text")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return (assign(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                F.lit(None).cast("int").alias("grown_shard"), "row_number", "position"))


def assign(rows: DataFrame) -> DataFrame:
    """Rows of ``op5_sharding`` in the order of doc_id, sixteen shards."""
    return sharding.assign_shards(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 16)


@_register
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_item", "n_shared", "containment")


_SHINGLES = """SELECT DISTINCT {key}, w[i:i + 4] AS shingle
  FROM (SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
        FROM (SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
              FROM {table}) t WHERE len(w) > 0) u"""
ORACLE_SQL["op6_benchmark_decontamination"] = f"""
WITH d AS ({_SHINGLES.format(key="doc_id", table="documents")}),
     b AS ({_SHINGLES.format(key="item_id", table="benchmark")}),
     n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN b ON d.shingle = b.shingle JOIN n ON n.item_id = b.item_id
GROUP BY doc_id, b.item_id, n_item HAVING count(*) / n_item >= 0.8"""


@_register
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_register
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log importance ratio, Gumbel key and decision for every document."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_register
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that the mix takes of every document, with their training times and positions."""
    docs = staged(mixing.sized(_table(spark, sf_dir, "documents")), "sizes")
    passes = [f"{c}_{e + 1}" for e in range(mixing.MAX_REPEATS) for c in ("at", "position")]
    return mixing.training_positions(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", *passes)


_COPIES = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
              CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
       FROM d GROUP BY source),
 r AS (SELECT *, sum(3 * source_size) OVER o AS held, sum(w) OVER o AS mass, row_number() OVER (ORDER BY source_size / w, source) AS pos FROM s
       WINDOW o AS (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(held, 0) AS DOUBLE)
                 / CAST((SELECT sum(w) FROM s) - coalesce(mass, 0) AS DOUBLE) AS level FROM r),
 v AS (SELECT arg_min(level, pos) AS level FROM l WHERE w * level <= 3 * source_size),
 t AS (SELECT source, source_size, least(w * v.level, 3.0::DOUBLE * source_size) AS target FROM s, v),
 p AS (SELECT d.*, t.source_size, t.target,
              coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 c AS (SELECT *, CAST(CASE WHEN size > 0 AND target - first - size / 2 > 0
                           THEN least(3, ceil((target - first - size / 2) / source_size)) ELSE 0 END AS INTEGER) AS copies FROM p)"""


_PASSES = ", ".join(f'max(CASE WHEN epoch = {e} THEN n."{c}" END) AS {c}_{e + 1}' for e in range(3) for c in ("at", "position"))
ORACLE_SQL["op10_training_order"] = _COPIES.rstrip() + f""",
 i AS (SELECT *, row_number() OVER () AS id, CASE WHEN dense_rank() OVER (ORDER BY source NULLS LAST) % 2 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM c),
 e AS (SELECT id, doc_id, source, slope, epoch, (first + epoch * source_size + size / 2) / target AS share
       FROM i, (VALUES (0), (1), (2)) AS passes (epoch) WHERE epoch < copies),
 a AS (SELECT *, 2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) AS "at" FROM e),
 n AS (SELECT *, row_number() OVER (ORDER BY "at", doc_id NULLS FIRST, source NULLS FIRST, epoch) - 1 AS position FROM a)
SELECT i.doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       any_value(size * copies) AS taken, any_value(i.source) AS source, any_value(copies) AS copies, {_PASSES}
FROM i LEFT JOIN n ON n.id = i.id GROUP BY i.id, i.doc_id"""


@_register
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels with crc32(doc_id) mod 4 = 2 are held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.ToxicityModel(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                                    "tokens", "evidence", "passages")


@_register
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[number(k) for k in secrets.BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"))


@_register
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


@_register
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    messages = staged(chat.as_chains(turns.unionByName(hard)), "messages")
    chats = chat.format_paths(messages, chat.chosen_paths(messages.drop("role", "text")))
    read = chats.select("tree", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


_BROKEN = r"regexp_replace(coalesce(text, ''), '(\\|<(\||/?s>|</?SYS>>)|\[/?INST\])', '\1_', 'g')"
ORACLE_SQL["op1_chat_formatting"] = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
 t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, length({_BROKEN}) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + n + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@_register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every field and line of every document."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


@_register
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each lang, and the terms that each source uses more."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
 w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY lang, source, term),
 k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
 v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 u AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n
       FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 s AS (SELECT lang, source, sum(n) AS n FROM u GROUP BY lang, source),
 p AS (SELECT u.lang, u.source, term, u.n, 1 + 1000000000 * (u.n + 5) // (s.n + 5 * v.v) AS p, 1 + 1000000000 * (lang_n + 5) // (v.n + 5 * v.v) AS q
       FROM u JOIN s ON s.lang = u.lang AND s.source = u.source JOIN v ON v.lang = u.lang),
 x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
 r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
       UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
 o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50"""


@_register
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrase collocations of each lang."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_phrase_collocations"] = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
 p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 c AS MATERIALIZED (SELECT lang, size, phrase, count(*)::HUGEINT AS a
       FROM (SELECT lang, k.size, unnest(list_transform(generate_series(1, len(w) - k.size + 1), lambda i: array_to_string(w[i:i + k.size - 1], ' '))) AS phrase
             FROM w, (VALUES (1), (2), (3)) AS k (size) WHERE len(w) >= k.size) u GROUP BY lang, size, phrase),
 n AS (SELECT lang, sum(a) AS n FROM c WHERE size = 1 GROUP BY lang),
 f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE size > 1 AND a >= 10),
 b AS MATERIALIZED (SELECT lang, phrase, a FROM c WHERE size < 3 AND a >= 10),
 z AS MATERIALIZED (SELECT lang, size, phrase, a, unnest(generate_series(1, size - 1)) AS k, w FROM f),
 y AS MATERIALIZED (SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM z),
 s AS (SELECT y.lang, y.size, y.phrase, y.a, y.k, h.a AS l, t.a AS r, 1000000 * y.a * y.a // (h.a * t.a) AS score
       FROM y JOIN b h ON h.lang = y.lang AND h.phrase = y.head JOIN b t ON t.lang = y.lang AND t.phrase = y.tail),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, k) = 1),
 i AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM f WHERE size = 3) GROUP BY lang, part),
 o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY m.score DESC, m.a DESC, m.phrase) AS rank
       FROM m LEFT JOIN i ON i.lang = m.lang AND i.part = m.phrase AND m.size = 2 WHERE i.a IS NULL OR 100 * i.a < 50 * m.a)
SELECT o.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""


@_register
def op11_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written into archives and read back."""
    pages = _table(spark, sf_dir, "pages")
    records = staged(warc.read_archives(warc.write_archives(pages), whole=False), "records")
    kind = pages.schema["page_id"].dataType
    return warc.resolved(records).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                         F.col("refers_to_page").cast(kind).alias("refers_to"))


ORACLE_SQL["op11_warc_archives"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest"""
