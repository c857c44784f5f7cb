"""The queries of this subpackage: thin wrappers of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, logbilinear, mih, packing, rlz, sharding, simhash, tokenstore, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbilinear.score(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mih.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_toxicity, op3_decontamination, op4_lm_scoring, op5_packing, op6_language_id,
        op7_token_store, op8_substring_dedup, op9_simhash, op10_nearest_neighbours,
    )
}

#: op1's SQL splits by the same md5 bits.  What is missing needs a hash, a
#: tokenizer or a trained model that SQL lacks, and is tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": """
WITH docs AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM documents
), sums AS (
  SELECT depth, substr(bits, 1, CAST(depth AS BIGINT)) AS prefix, sum(n_bytes) AS b, count(*) AS n
  FROM docs, generate_series(0, 40) AS d(depth) GROUP BY ALL
), fitting AS (
  SELECT docs.doc_id, min(depth) AS depth
  FROM docs JOIN sums ON substr(bits, 1, CAST(depth AS BIGINT)) = prefix
  WHERE b <= 1048576 OR n = 1 GROUP BY docs.doc_id
)
SELECT docs.doc_id, n_bytes, substr(bits, 1, CAST(depth AS BIGINT)) AS shard_id,
       CAST(depth AS INTEGER) AS local_depth, n_bytes > 1048576 AS oversize
FROM docs JOIN fitting USING (doc_id)
""",
    "op3_decontamination": """
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM wins),
spots AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), found AS MATERIALIZED (SELECT spots.doc_id, spots.i, spots.size, item_id FROM spots JOIN wins USING (size, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
""",
    "op8_substring_dedup": """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
spots AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS m FROM spots GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM spots JOIN first USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
""",
}
