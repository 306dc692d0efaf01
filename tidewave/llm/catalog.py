"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, exact_dedup, line_dedup, lm_scoring, manifest, packing, pii, quality, sentence_pieces, simhash, topk_search, url_filter, whitening
from .shared import table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3).drop("row")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("row")


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


#: The pseudonyms' key. A production run passes its own secret.
PII_KEY = "tidewave demonstration key"


def op4_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_documents(table(spark, sf_dir, "documents"), PII_KEY)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels whose id is the page's: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (
  SELECT host, count(o.bad) AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad,
         array_to_string(string_split(host, '.')[-2:], '.') AS two, array_to_string(string_split(host, '.')[-3:], '.') AS three, string_split(host, '.')[-1] AS one
  FROM p LEFT JOIN (SELECT doc_id AS page_id, (quality = 0 OR toxic = 1)::INT AS bad FROM labels) o USING (page_id) GROUP BY host),
hd AS (SELECT host, n, bad, CASE WHEN two IN TWO_LABELS THEN three ELSE two END AS domain,
              CASE WHEN two IN TWO_LABELS THEN two ELSE one END AS suffix FROM h),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM d) AS m FROM d GROUP BY suffix),
ks AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE 1 / least(greatest((sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - count(*)) / (sum(n) - count(*)), 1e-3), 0.9) - 1 END AS k FROM s0 WHERE n > 0),
s AS (SELECT suffix, (m * k + bad) / (k + n) AS m FROM s0, ks),
d0 AS (SELECT domain, n, bad, m FROM d JOIN s USING (suffix)),
kd AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE 1 / least(greatest((sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - count(*)) / (sum(n) - count(*)), 1e-3), 0.9) - 1 END AS k FROM d0 WHERE n > 0),
d1 AS (SELECT domain, (m * k + bad) / (k + n) AS m FROM d0, kd),
h0 AS (SELECT host, n, bad, m FROM hd JOIN d1 USING (domain)),
kh AS (SELECT CASE WHEN count(*) = 0 OR sum(n) <= count(*) THEN 1.0 ELSE 1 / least(greatest((sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - count(*)) / (sum(n) - count(*)), 1e-3), 0.9) - 1 END AS k FROM h0 WHERE n > 0),
h1 AS (SELECT host, m * k + bad AS a, (1 - m) * k + n - bad AS b, (m * k + bad) / (k + n) AS post FROM h0, kh),
h2 AS (SELECT host, a, b, ln(a / b) - 12 * sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) AS low, 24 * sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) / 400 AS h, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS top FROM h1 WHERE post > 0.475),
u AS (SELECT host, a, b, top, h, unnest(list_transform(range(400), lambda i: low + (i + 0.5) * h)) AS u FROM h2),
f AS (SELECT host, greatest(least(u / h + 0.5, 1), 0) AS part, exp(-a * ln(1 + exp(least(-u, 700))) - b * ln(1 + exp(least(u, 700))) - top) AS density FROM u),
sure AS (SELECT host FROM f GROUP BY host HAVING sum(density * part) / sum(density) > 0.95),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
own AS (SELECT h1.host, CASE WHEN sure.host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM h1 LEFT JOIN sure ON h1.host = sure.host),
r AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, p.host, p.path, r.rule, coalesce(r.verdict, own.verdict) AS verdict
FROM p JOIN own ON p.host = own.host LEFT JOIN r ON p.host = r.host AND p.path = r.path
""".replace("TWO_LABELS", str(url_filter.TWO_LABEL_SUFFIXES))


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), lm_scoring.fold()).drop("row")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), with_ids=False).drop("row")


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op9_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY row ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT row, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM (SELECT *, row_number() OVER () AS row FROM documents))),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT row) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY row, doc_id
"""


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), with_ids=False).drop("row")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def merkle_sql(heights: int = 8, top_heights: int = 4, fan: int = 16) -> str:
    """Trees of up to ``fan`` to the ``heights`` leaves, level by level; a node alone in its tree stays as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # CRC-32 of the decimal digits: each is combined in, then eight shifts
    steps = "flatten(list_prepend([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)], [-1, -1, -1, -1, -1, -1, -1, -1]))))"
    crc = f"xor(list_reduce(list_transform({steps}, lambda x: x::BIGINT), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
    parts = [f"l AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf('text')} END AS altered FROM documents)",
             "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM l)",
             "n0 AS (SELECT tree, rank AS k, leaf AS d, count(*) OVER (PARTITION BY tree) AS m FROM a0)"]

    def grow(name: str, count: int) -> None:
        for i in range(count):
            up = f"SELECT tree, k // {fan} AS k, CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY k)) END AS d FROM {name}{i} GROUP BY tree, k // {fan}"
            parts.append(f"{name}{i + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM ({up}))")

    grow("n", heights)
    parts.append(f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS k, d, count(*) OVER () AS m, tree AS source FROM n{heights})")
    grow("t", top_heights)
    # siblings, level by level: each step takes the node's place in its tree and its digest so far
    def climb(table: str, name: str, i: int) -> str:
        left, right = (f"coalesce((SELECT string_agg(s.d, '' ORDER BY s.k) FROM {name}{i} s WHERE s.tree = {table}.{name} AND s.k // {fan} = {table}.k // {fan} AND s.k {sign} {table}.k), '')" for sign in "<>")
        return f"SELECT * EXCLUDE (lefts, rights, m) REPLACE (k // {fan} AS k, proof || lefts || rights AS proof, CASE WHEN m = 1 THEN fold ELSE sha256(lefts || fold || rights) END AS fold) FROM (SELECT *, {left} AS lefts, {right} AS rights, (SELECT any_value(m) FROM {name}{i} s WHERE s.tree = {table}.{name}) AS m FROM {table})"

    parts.append("p0 AS (SELECT doc_id, leaf, tree AS n, '' AS t, rank AS k, '' AS proof, altered AS fold FROM a0)")
    for i in range(heights):
        parts.append(f"p{i + 1} AS ({climb(f'p{i}', 'n', i)})")
    parts.append(f"q0 AS (SELECT p.* REPLACE (t0.k AS k), t0.d AS subroot FROM p{heights} p JOIN t0 ON t0.source = p.n)")
    for i in range(top_heights):
        parts.append(f"q{i + 1} AS ({climb(f'q{i}', 't', i)})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, t{top_heights}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t{top_heights}.d AS verified FROM q{top_heights}, t{top_heights}"


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict:
    found = (
        op1_best_fit_packing, op2_simhash_near_dedup, op3_exact_dedup, op4_pii_feistel, op5_url_reputation, op6_ppm_scoring,
        op7_sentence_pieces, op8_kneser_ney_quality, op9_maxscore_topk, op10_line_dedup, op11_byte_pairs, op12_merkle_manifest,
        op13_embedding_whitening,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_url_reputation": OP5_SQL, "op9_maxscore_topk": OP9_SQL, "op10_line_dedup": OP10_SQL, "op12_merkle_manifest": merkle_sql()}
