"""The registered queries of the training-data operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calendrix.llm import conversations, decontaminate, hmm, licences, line_dedup, minhash, mixing, quality, simhash, token_counts, toxicity, url_filter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: One large source is wanted twice as much as each of the others.
MIX_WEIGHTS = {"src0": 2.0}


def op2_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op3_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_licences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs))


def op7_hmm_scores(spark, sf_dir):
    return hmm.score(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_fingerprints(spark, sf_dir):
    near = minhash.compare_with_next(table(spark, sf_dir, "documents"))
    near = near.withColumn("edited_sha256", F.sha2("edited_text", 256))
    hexes = {c: minhash.hexed(c) for c in ("fingerprint", "edited_fingerprint")}
    return near.withColumns(hexes).select("doc_id", "n_chars", "edited_sha256", *hexes, "near_edited", "near_next")


def op11_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return conversations.report(turns, conversations.damage(turns))


def op12_whitening(spark, sf_dir):
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_quality(spark, sf_dir):
    rows = quality.featured(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(rows, quality.train(rows))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_licences": op6_licences,
    "op7_hmm_scores": op7_hmm_scores,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversations": op11_conversations,
    "op12_whitening": op12_whitening,
    "op13_quality": op13_quality,
}

LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

MIX_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT source, CASE WHEN source = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         CAST(sum(greatest(length(coalesce(text, '')), 1)) AS BIGINT) AS size
  FROM documents GROUP BY source
), rates AS (
  SELECT source, weight / sum(weight) OVER () * (1.0::DOUBLE * CAST(sum(size) OVER () AS BIGINT)) / size AS rate FROM sizes
), pieces AS (
  SELECT source, CAST(greatest(ceil(rate / 16), 1) AS INTEGER) AS n, rate FROM rates
), cdf AS (
  SELECT source, n, 0 AS k, rate / n AS lam, exp(-(rate / n)) AS p, exp(-(rate / n)) AS c FROM pieces
  UNION ALL
  SELECT source, n, k + 1, lam, p * lam / (k + 1), c + p * lam / (k + 1) FROM cdf WHERE k < 79
), tables AS (
  SELECT source, n, list(c ORDER BY k) AS cs FROM cdf GROUP BY source, n
), draws AS (
  SELECT d.doc_id, d.source, t.cs, unnest(range(1, t.n + 1)) AS piece
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
), counts AS (
  SELECT doc_id, CAST(sum(len(list_filter(cs, lambda c:
           c <= CAST('0x' || md5('17:' || doc_id || ':' || piece)[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE))) AS INTEGER) AS copies
  FROM draws GROUP BY doc_id
), copied AS (
  SELECT doc_id, unnest(range(1, copies + 1)) AS copy_no FROM counts WHERE copies > 0
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.copy_no AS INTEGER) AS copy_no,
       md5('17:' || d.doc_id || ':' || c.copy_no || ':order') AS mix_key
FROM copied c JOIN documents d USING (doc_id)
"""

ORACLES = {
    "op2_mix_sources": MIX_SQL,
    "op4_line_dedup": LINE_DEDUP_SQL,
}
