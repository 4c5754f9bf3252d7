"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm import (context_tree, decontaminate, filter_audit, html_extract, licenses, near_dup, packing, pii, quality, secrets,
                         substrings, wacz, whitening)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1
    return context_tree.score(docs, train)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", (F.size("items") + F.col("nameless").cast("int")).cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_wacz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find(_table(spark, sf_dir, "documents"), licenses.templates(spark))
    return found.select("doc_id", "license_id", "n_shingles", "n_found")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = secrets.base_of(F.col("spans"))
    return found.select(
        "doc_id",
        *[secrets.number_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.names(base), 256).alias("base_sha256"), secrets.names(F.col("spans")).alias("spans"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).select("doc_id", "spans")
    base = pii.base_of(F.col("spans"))
    return found.select(
        "doc_id", *[pii.number_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.names(base), 256).alias("base_sha256"), pii.names(F.col("spans")).alias("spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_context_tree": op1_context_tree,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontamination": op3_decontamination,
    "op4_wacz": op4_wacz,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_secret_scan": op9_secret_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_pii": op11_pii,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}

_NOTICES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licenses.TEMPLATES)

SQL = {
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
               CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
               CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
               CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
               CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
      FROM d LEFT JOIN k ON k.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY part, fails),
l(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.a || q.a || r.a || s.a || t.a AS filter_order FROM l p, l q, l r, l s, l t
      WHERE len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS a, filter_order[1:step - 1] AS before, filter_order[1:step] AS so_far
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
m AS (SELECT part, filter_order, step, a,
        sum(n) FILTER (translate(fails, so_far, '') = fails) AS kept,
        sum(n) FILTER (contains(fails, a) AND translate(fails, before, '') = fails) AS removed,
        sum(n) FILTER (contains(fails, a) AND translate(fails, before, '') <> fails) AS redundant,
        sum(n) FILTER (fails = a) AS unique_fails,
        sum(g) FILTER (contains(fails, a) AND translate(fails, before, '') = fails) AS good_lost,
        sum(x) FILTER (contains(fails, a) AND translate(fails, before, '') = fails) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, a)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, a) AS BIGINT) AS shapley
FROM m""",
    "op8_license_scan": r"""
WITH t(license_id, text) AS (VALUES {notices}),
b AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, NULL AS license_id, text FROM documents
      UNION ALL SELECT 't', 0, NULL, license_id, text FROM t),
w AS (SELECT * EXCLUDE text, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM b),
s AS (SELECT DISTINCT side, rid, doc_id, license_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
n AS (SELECT license_id, count(*) AS n_shingles FROM s WHERE side = 't' GROUP BY license_id)
SELECT DISTINCT doc_id, n.license_id, n_shingles, n_found
FROM (SELECT d.rid, d.doc_id, x.license_id, count(*) AS n_found FROM s d JOIN s x ON d.side = 'd' AND x.side = 't' AND d.g = x.g
      GROUP BY ALL) f JOIN n ON n.license_id = f.license_id AND n_found >= 0.8 * n_shingles""".replace("{notices}", _NOTICES),
    "op3_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
             FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.rid = d.rid LEFT JOIN t ON t.rid = d.rid""",
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
        list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\x20\x09-\x0D]*')) AS ls
      FROM d),
g AS (SELECT rid, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS h
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM r) GROUP BY rid),
s AS (SELECT w.rid, doc_id, text, ws, len(ls) AS n_lines, len(ws) AS n_words,
        length(list_aggregate(list_concat([''], ws), 'string_agg', '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS capitals,
        length(regexp_replace(text, '[^!?]+', '', 'g')) AS exclaims,
        length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits
      FROM w LEFT JOIN c ON c.rid = w.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) OR (word_chars >= 40 AND 2 * capitals > word_chars)
       OR 3 * exclaims > n_words OR 2 * digits > word_chars) AS kept
FROM b""",
    "op9_secret_scan": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
p(kind, rank, pat) AS (VALUES
  ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]{14,}'), ('hex', 2, '[0-9a-f]{16,}'), ('candidate', 3, '[A-Za-z0-9+/_=-]{24,}')),
l AS (SELECT rid, kind, rank, pat, regexp_extract_all(text, pat) AS found,
        string_split_regex(text, pat) AS gaps FROM d, p),
m AS (SELECT rid, kind, rank, pat, i, found[i] AS s,
        sum(length(gaps[i]) + CASE WHEN i > 1 THEN length(found[i - 1]) ELSE 0 END)
          OVER (PARTITION BY rid, kind ORDER BY i) AS b
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM l)),
base AS (SELECT rid, kind, rank, b, b + length(s) AS e FROM m
  WHERE (kind = 'assign' AND length(regexp_extract(s, pat, 1)) >= 12)
     OR (kind = 'access' AND length(s) >= 18) OR (kind = 'hex' AND length(s) >= 16)),
c AS (SELECT rid, b, s,
        CASE WHEN (regexp_full_match(s, '[0-9a-f]+') OR regexp_full_match(s, '[0-9A-F]+'))
               AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-fA-F]') THEN 'entropy_hex'
             WHEN regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')
               THEN 'entropy_base64' END AS kind
      FROM m WHERE kind = 'candidate' AND length(s) >= 24
       AND NOT regexp_matches(s, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')
       AND NOT regexp_matches(lower(s), 'example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)|test[_-]?(key|token)|0123456789|abcdefghijk|qwertyuiop|^(sha256|sha384|sha512)-|/(usr|etc|var|home|static|assets|images|docs)/')
       AND NOT list_bool_or([contains(s, repeat(x, 8)) FOR x IN string_split(s, '')])),
w AS (SELECT rid, kind, b AS cb, b + j AS b,
        list_aggregate(string_split(s[j + 1:j + 24], ''), 'entropy') AS h
      FROM (SELECT *, unnest(range(0, length(s) - 23)) AS j FROM c WHERE kind IS NOT NULL)),
hot AS (SELECT rid, kind, cb, b, CASE WHEN b - lag(b) OVER o <= 24 THEN 0 ELSE 1 END AS fresh FROM w
        WHERE h >= CASE kind WHEN 'entropy_hex' THEN 3.05 ELSE 4.05 END WINDOW o AS (PARTITION BY rid, cb ORDER BY b)),
isle AS (SELECT rid, kind, cb, b, sum(fresh) OVER (PARTITION BY rid, cb ORDER BY b) AS g FROM hot),
extra AS (SELECT rid, kind, CASE kind WHEN 'entropy_base64' THEN 3 ELSE 4 END AS rank, min(b) AS b, max(b) + 24 AS e
          FROM isle GROUP BY rid, cb, kind, g),
spans AS (SELECT * FROM base UNION ALL
          SELECT * FROM extra x WHERE NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = x.rid AND y.b <= x.b AND x.e <= y.e)),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS bs,
        string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS sp
      FROM (SELECT rid, kind, rank, CAST(b AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM spans) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN a ON a.rid = d.rid""",
}
