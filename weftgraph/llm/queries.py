"""One query for each corpus operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, context_tree, decontaminate, filter_audit, host_rules, language, main_text, near_dup, packing, perplexity, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.chat_digest(chat.read_back(chat.format_chats(rows.unionByName(more), chat.text_part(F.col("text")))))


ORACLES["op1_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS er FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(er) + 1 + length(et) + length('<|im_end|>') + 1) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(table(spark, sf_dir, "documents")).select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


ORACLES["op3_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, source, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
q AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1),
v AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM q) GROUP BY r),
c AS (
  SELECT w.r, doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN v USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c),
f AS (SELECT *, (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
  OR word_chars < 1.5::DOUBLE * n_words OR word_chars > 40.0::DOUBLE * n_words) AS failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS f FROM f GROUP BY source),
t AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS h, sum(f * f / n) AS ff, sum(n * n) AS nn, sum(f) / sum(n) AS m FROM h),
u AS (SELECT *, CASE WHEN n - nn / n > 0 THEN (ff - f * m - (h - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS v FROM t),
s AS (SELECT m, CASE WHEN v > 0 THEN least(1e6, greatest(1e-3, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM u),
x AS (SELECT source, (f + m * k) / (n + k) >= 0.6 AS refused FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT failed AND NOT refused) AS kept
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), 2048)


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_histories(table(spark, sf_dir, "pages"), min_bytes=0)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
d AS (SELECT page_id, payload_bytes, x, (
    SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1), '' ORDER BY i)
    FROM range(32) t(i)) AS payload_digest FROM h),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM m
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


ORACLES["op6_decontamination"] = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents, low),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark, low),
m AS (SELECT item_id, w, least(len(w), 10) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS p FROM m)),
ks AS (SELECT DISTINCT k FROM m),
dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, (len(w) - k + 2)::BIGINT)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT r, p, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)
"""


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dup.near_duplicates(table(spark, sf_dir, "documents"), 0.8)
    return classes.select("doc_id", "class_id")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_tree.score_documents(table(spark, sf_dir, "documents"))
    return context_tree.code_length_per_byte(scored).drop("n_bytes")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_by_perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_interactions"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(toxic, false)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM x p, x q, x r, x s, x t
  WHERE p.b | q.b | r.b | s.b | t.b = 31),
g AS (SELECT filter_order, k AS step, bs[k] AS bit, coalesce(list_sum(bs[1:k - 1]), 0)::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM o)),
r AS (SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, g GROUP BY part, filter_order, step),
s AS (SELECT part, substr(filter_order, step, 1) AS f, sum(removed)::BIGINT AS shapley FROM r GROUP BY 1, 2)
SELECT r.*, shapley FROM r JOIN s ON r.part = s.part AND s.f = substr(filter_order, step, 1)
"""


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))
