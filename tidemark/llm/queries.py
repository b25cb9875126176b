"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe,
    exact,
    html_text,
    licenses,
    lines,
    negatives,
    packing,
    periodic,
    simhash,
    substring,
    token_counts,
    topk,
    toxicity,
)
from tidemark.llm.shared import SPACE

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sha256(column: str) -> Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode_texts(read(spark, sf_dir, "documents"), vocabulary)
    decoded = bpe.decode_ids(encoded, vocabulary)
    return decoded.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        sha256("text").alias("decoded_sha256"),
    )


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    classifier = toxicity.train(docs, read(spark, sf_dir, "labels"))
    found = toxicity.scores(docs, classifier).select("row.doc_id", "score")
    predicted = (F.col("score") >= 0.5).cast("int")
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeated(read(spark, sf_dir, "documents"), window=50)
    words = F.trim(F.regexp_replace(F.coalesce("kept", F.lit("")), SPACE, " "))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_similar_lines(read(spark, sf_dir, "documents"), distance=None, similarity=0.8, digits=True)
    return found.select("row.doc_id", "n_lines", "n_removed", sha256("kept").alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary, capacity=2048, end_id=0)
    return packed.withColumnRenamed("id", "doc_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_main_text(read(spark, sf_dir, "pages"))
    n_chars = F.length("text").cast("bigint")
    return found.select("row.page_id", "row.url", "text", n_chars.alias("n_chars"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read(spark, sf_dir, "documents"), shingle=3, distance=3)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(read(spark, sf_dir, "documents"), digest=True)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "detections.label")).alias("labels"),
        F.coalesce(F.array_max("detections.score"), F.lit(0.0)).alias("score"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = token_counts.count_tokens(read(spark, sf_dir, "documents"), model)
    over = (F.col("n_tokens") > 4096).alias("over_limit")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", over)


#: Words of every tenth document from a place on repeat with a period, both given by a hash of its id.
PLANTED = f"""
CASE WHEN crc32(CAST(doc_id AS STRING)) % 10 = 0 THEN
  transform(array(filter(split(coalesce(text, ''), r'{SPACE}'), w -> w <> '')), words -> array_join(
    transform(
      array(struct(floor(crc32(CAST(doc_id AS STRING)) / 10) AS g)), x -> transform(
        array(struct(
          CAST(x.g % greatest(size(words), 1) AS INT) AS a,
          CAST(1 + (size(words) - x.g % greatest(size(words), 1)) DIV (3 + x.g % 8) AS INT) AS p)),
        y -> transform(words, (w, i) -> IF(i >= y.a, words[y.a + (i - y.a) % y.p], w)))[0])[0],
    ' '))[0]
ELSE text END"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.expr(PLANTED).alias("text"))
    found = periodic.periodic_runs(docs, least=12)
    longest = "array_max(transform(runs, r -> struct(r.length, -r.start AS before, -r.period AS finer)))"
    listed = "array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')"
    found = found.select("row.doc_id", "runs", F.expr(longest).alias("longest"), "collapsed", F.expr(listed).alias("listed"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.expr("-longest.before").alias("start"),
        "longest.length",
        F.expr("-longest.finer").alias("period"),
        F.expr("1000 * longest.length DIV -longest.finer").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, changed)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_html_extraction": op7_html_extraction,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op4_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (
  SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS window_text
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w)),
f AS (SELECT window_text, min(doc_id) AS least FROM p GROUP BY window_text),
g AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k
  FROM p JOIN f USING (window_text) WHERE doc_id > least),
e AS (SELECT doc_id, k, words[k] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM w)),
r AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY k) FILTER (WHERE g.k IS NULL) AS kept, count(g.k) AS n_removed
  FROM e LEFT JOIN g USING (doc_id, k) GROUP BY e.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
""",
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
""",
}
