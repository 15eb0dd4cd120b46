"""The registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.session import scratch_folder

from . import (
    decontam, dialogue, guesscost, jaccard, linededup, mix, postings, pst, quality, repair, resample, urltrie, warc)
from .common import stored, table


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair.write_token_shards(table(spark, sf_dir, "documents"), tokenizer_file())
    return repair.read_token_documents(shards)


def op2_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = guesscost.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
    return found.select("doc_id", "secrets.*")


def op3_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pst.score_texts(table(spark, sf_dir, "documents"), quality.fold(F.col("doc_id"), 5) == 1)
    return scored.withColumnRenamed("id", "doc_id")


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# The rules of the query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op6_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urltrie.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix.mix_sources(docs, mix.word_count(F.col("text"))).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = stored(quality.with_statistics(docs).drop("text"), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").dropna()
    learn = measured.join(labels, "doc_id").where(quality.fold(F.col("doc_id"), 3) != 1)
    scored = quality.score_statistics(measured, quality.fit_quality(learn, "quality"))
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    n = F.size("lines").cast("long")
    return out.select(F.col("id").alias("doc_id"), n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"),
                      F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


def op10_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start", "end", "edits")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired = dialogue.repair_conversations(dialogue.damage(conversations))
    found = dialogue.with_lost_conversations(repaired.conversations, conversations)
    return found.withColumnRenamed("conv", "conv_id").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"), scratch_folder(spark, "archives"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


QUERIES = {f.__name__: f for f in (
    op1_repair_tokens, op2_guess_cost, op3_voronoi_join, op4_suffix_tree, op5_posting_lists, op6_url_trie, op7_mix_sources,
    op8_fourier_quality, op9_line_bitmaps, op10_qgram_lemma, op11_importance_resample,
    op12_conversation_repair, op13_arc_to_warc)}

# DuckDB has no crc32: the table of the polynomial's remainders, and one step per byte.
CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY b) AS t
  FROM (SELECT b, reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, b::BIGINT) AS c
        FROM range(256) r(b)))"""


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes; ``t`` is the column of crc_table."""
    byte = ("(strpos('0123456789ABCDEF', substr(hex({0}), 2 * i - 1, 1)) - 1) * 16"
            " + strpos('0123456789ABCDEF', substr(hex({0}), 2 * i, 1)) - 1").format(text)
    return (f"xor(reduce(list_transform(range(1, strlen({text}) + 1), lambda i: ({byte})::BIGINT),"
            " lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)")


ORACLE_SQL: dict[str, str] = {
    "op12_conversation_repair": rf"""
WITH RECURSIVE {CRC_TABLE},
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc32_sql("k")} % 20 AS kind FROM src, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, (VALUES (1), (2)) copies(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
         left(role, 1) AS ini, rtrim(text, E' \t\n\x0b\x0c\r') AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged)),
rows_ AS (
  SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS dup,
         body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AS cut,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (dup)::BIGINT AS duplicate,
         count(*) FILTER (cut AND NOT dup)::BIGINT AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n
  FROM rows_ GROUP BY conv_id),
-- One struct of cost and audit per state; the least struct is the cheapest, ties ASCII-least.
steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS e, {{'c': 1000000, 'a': ''}} AS s, {{'c': 3, 'a': 'I'}} AS u, {{'c': 6, 'a': 'II'}} AS v
  FROM sums
  UNION ALL
  SELECT conv_id, i, e, s,
         list_min([u, {{'c': e.c + 3, 'a': e.a || 'I'}}, {{'c': s.c + 3, 'a': s.a || 'I'}}, {{'c': v.c + 3, 'a': v.a || 'I'}}]),
         list_min([v, {{'c': u.c + 3, 'a': u.a || 'I'}}, {{'c': e.c + 6, 'a': e.a || 'II'}}, {{'c': s.c + 6, 'a': s.a || 'II'}}])
  FROM (
    SELECT t.conv_id, t.i + 1 AS i, {{'c': e.c + 4, 'a': e.a || 'D'}} AS e,
           list_min([{{'c': s.c + 4, 'a': s.a || 'D'}}, {{'c': CASE WHEN ini = 's' THEN e.c + stay ELSE 1000000 END, 'a': e.a || 'K'}}]) AS s,
           list_min([{{'c': u.c + 4, 'a': u.a || 'D'}}, {{'c': e.c + stay + to_u, 'a': e.a || by_u}},
                     {{'c': s.c + stay + to_u, 'a': s.a || by_u}}, {{'c': v.c + stay + to_u, 'a': v.a || by_u}}]) AS u,
           list_min([{{'c': v.c + 4, 'a': v.a || 'D'}}, {{'c': u.c + stay + to_a, 'a': u.a || by_a}}]) AS v
    FROM steps t JOIN (
      SELECT conv_id, i, ini, CASE WHEN blank OR dup THEN 1000000 WHEN cut THEN 3 ELSE 0 END AS stay,
             CASE WHEN ini = 'u' THEN 0 ELSE 3 END AS to_u, CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END AS by_u,
             CASE WHEN ini = 'a' THEN 0 ELSE 3 END AS to_a, CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END AS by_a
      FROM rows_) r ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = t.i + 1)),
best AS (
  SELECT t.conv_id, list_min([e, v]) AS b FROM steps t JOIN sums ON t.conv_id IS NOT DISTINCT FROM sums.conv_id AND t.i = sums.n),
edits AS (
  SELECT conv_id, j, b.a[j] AS edit, length(translate(b.a[:j], 'I', '')) AS i,
         count(*) FILTER (b.a[j] <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS place
  FROM (SELECT conv_id, b, unnest(range(1, length(b.a) + 1)) AS j FROM best)),
kept AS (
  SELECT x.conv_id, x.j, x.edit, x.place, CASE WHEN x.edit <> 'I' THEN r.text ELSE '' END AS text, r.role,
         max((x.edit = 'K' AND r.ini = 's')::INT) OVER (PARTITION BY x.conv_id) AS has_s
  FROM edits x LEFT JOIN rows_ r ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.i = r.i WHERE x.edit <> 'D'),
text_ AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || text, E'\n' ORDER BY j) AS whole FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id
LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
LEFT JOIN text_ ON c.conv_id IS NOT DISTINCT FROM text_.conv_id""",
    "op13_arc_to_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper,
         row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS place FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN keeper END AS refers_to
FROM f""",
    "op11_importance_resample": rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', 0, NULL, coalesce(text, '') FROM benchmark),
w AS (
  SELECT kind, r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
b AS (
  SELECT word, {crc32_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc_table),
n AS (
  SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM w JOIN b USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
f AS (
  SELECT r, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight
  FROM w JOIN b USING (word) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY r),
c AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN f USING (r) WHERE kind = 'd'),
v AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM c),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS able FROM v)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM o""",
    "op6_url_trie": r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT p.page_id, p.host, p.path,
         (SELECT max({'n': length(rhost || rpath), 'verdict': verdict, 'rule': rhost || rpath}) FROM rules
          WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged""",
    "op7_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
lv AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS level,
         sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s),
r AS (
  SELECT *, greatest(0.0::DOUBLE, total - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM lv),
t AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT rate FROM r WHERE level >= rate ORDER BY level LIMIT 1) * w, cap)) AS target
  FROM r),
b AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS cut,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN cut // source_size ELSE 0 END AS epochs FROM b)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, cut - epochs * source_size - before)))::BIGINT AS taken
FROM e""",
    "op9_line_bitmaps": r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line,
               generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)),
c AS (
  SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT l.*, (c.k IS NULL OR l.doc_id = c.owner) AS stays FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
