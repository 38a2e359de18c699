"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, jaccard, licences, media, packing, secrets, sharding, toxicity
from .common import unsigned_crc32

#: Shards of op2, and bytes that each row counts besides its text.
SHARDS, ROW_BYTES = 40, 16
#: Bytes of a packed bin: about 4,096 tokens.
BIN_BYTES = 16_384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: one row for each row of ``pages``, null and empty ones with an empty text; no rows for no pages."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents by law ``bytes``: null and empty texts count their 16 bytes; equal ids go by size and checksum; repeated rows are rows of their own; a document larger than a shard fills it alone."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), unsigned_crc32(F.col("text")).alias("text_crc32"))
    placed = sharding.balanced_shards(rows, ["doc_id", "size", "text_crc32"], "size", SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text as stored and read back: null as empty; ids of any type, null or repeated, one row each; no rows for no documents."""
    folder = media.write_archives(table(spark, sf_dir, "documents"), "doc_id", "text")
    digests = media.media_digests(media.read_archives(spark, folder), "doc_id")
    # A member that can't be read, after its retries, fails the query rather than be missed.
    return digests.withColumn("feature", F.when(F.col("error").isNull(), F.col("feature")).otherwise(F.raise_error(F.col("error")).cast("string"))).drop("error")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, one row each, repeated ids too; null and empty texts get the score of a text without known words. Null ids are held out. Without labels every score is 0.5."""
    documents = table(spark, sf_dir, "documents")
    index = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, index, keep=["doc_id"])
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the benchmark in every document, one row each; null and empty texts have no words and are clean; repeated items count once by id; an empty benchmark hits nothing."""
    found = decontaminate.find_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all documents: see ``packed``."""
    return packed(table(spark, sf_dir, "documents"))


def packed(documents: DataFrame) -> DataFrame:
    """Bins of ``documents``, one row for each: equal texts are a duplicate cluster, a byte parts two texts; null and empty texts are one byte and in no cluster; null sources conflict with nothing."""
    rows = documents.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.when(F.octet_length("text") > 0, F.xxhash64("text")).alias("cluster"))
    return packing.pack(rows, "doc_id", "size", "source", "cluster", BIN_BYTES)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1; rows of one turn go by role, then text; null texts and roles are empty; rows without a conversation are one; a table without rows leaves -1 alone."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = f"{chat.END}{chat.START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(turns.unionByName(more))
    return chat.conversation_digests(windows)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in every document, one row each; null and empty texts have none; of spans with one start the order of the rules counts."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in secrets.BASE_RULES)

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(secrets.joined("secret_spans", base).cast("binary"), 256).alias("base_sha256"), secrets.joined("secret_spans").alias("spans"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document, one row each; null and empty texts have none (empty strings, null probability)."""
    found = licences.find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licences", lambda x: x["confirmed"] | (x["contained"] >= licences.CONFIRM))
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"])), ",").alias("paragraphs"),
        F.round(F.array_max(F.transform(sure, lambda x: x["probability"])), 6).alias("probability"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document, one row each; null and empty texts are alone; null ids count as the largest; repeated ids with other texts are other documents."""
    return jaccard.ngram_groups(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_extraction, op2_sharding, op3_media_columns, op4_toxicity, op5_decontamination, op6_best_fit_packing, op7_chat_formatting, op8_secret_scans, op9_license_scans, op10_ngram_jaccard_join)}


_WORDS5 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP5 = rf"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS5} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS5} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
hits AS (
  SELECT r, i, d.n, item FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes) d
  JOIN grams g ON g.n = d.n AND g.g = array_to_string(w[i:i + d.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


def _op8() -> str:
    parts = []
    for order, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        value = f"length(m) - length(regexp_extract(m, '^{rule.head.replace(chr(39), chr(39) * 2)}'))" if rule.head else "length(m)"
        parts.append(f"""
SELECT r, {order} AS o, '{rule.kind}' AS kind, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a, f[i] AS m, {value.replace("m)", "f[i])").replace("(m", "(f[i]")} AS v, {rule.least} AS least
FROM (SELECT r, s, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT r, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS f FROM doc))""")
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT r, o, kind, CAST(a AS BIGINT) AS a, kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(m) AS BIGINT) AS VARCHAR) AS s FROM ({" UNION ALL ".join(parts)}) WHERE v >= least)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY a, o) FILTER (kind IN ({base})), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, o), '') AS spans
FROM doc LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""


_OP10 = r"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM doc),
classes AS (SELECT min(r) AS c, min(doc_id) AS least_id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
gram AS (SELECT c, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS x FROM gram a JOIN gram b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c),
links AS (SELECT a, b FROM pairs WHERE 100 * x >= 85 * (na + nb - x)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, d) AS (SELECT c, c FROM classes UNION SELECT reach.c, edges.b FROM reach JOIN edges ON edges.a = reach.d),
least AS (SELECT reach.c, min(k.least_id) AS component_id FROM reach JOIN classes k ON k.c = reach.d GROUP BY reach.c)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE least.component_id END AS component_id
FROM sets LEFT JOIN classes ON classes.s = sets.s AND len(sets.s) > 0 LEFT JOIN least ON least.c = classes.c
"""
# CRC-32 by its definition (polynomial EDB88320, reflected), over the UTF-8 bytes written as hex digits.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(hex(encode(t)), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc_table[CAST(xor(c, b) & 255 AS INTEGER) + 1])))"
_OP2 = f"""
WITH bits AS (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b)),
tab AS (SELECT list(v ORDER BY b) AS crc_table FROM bits),
doc AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {ROW_BYTES} AS size FROM documents),
crc AS (SELECT doc_id, CAST(size AS BIGINT) AS size, {_CRC} AS text_crc32 FROM doc, tab),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS whole FROM crc),
shards AS (SELECT *, CAST(least({SHARDS - 1}, ((2 * start + size) * {SHARDS}) // (2 * whole)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM shards
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": _OP2, "op5_decontamination": _OP5, "op8_secret_scans": _op8(), "op10_ngram_jaccard_join": _OP10}
