"""One query per operator over the driver's tables, and the SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, lm_scoring, mixing, toxicity
from .common import scratch_path
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .ngram_join import similar_components
from .sampling import crc_part
from .substring_dedup import digest, without_repeats
from .token_records import with_starts, write_records

END_ID = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = crc_part(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.where(~held_out))
    found = language_id.with_language(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_records(documents(spark, sf_dir), scratch_path(spark, "records"), tokenizer_path(), END_ID)
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = crc_part(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels.where(~held_out))
    found = toxicity.with_toxicity(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(documents(spark, sf_dir).select("doc_id", "text", "source"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir), n=4, percent=85)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(without_repeats(documents(spark, sf_dir)))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_part(F.col("doc_id"), 10)
    docs = documents(spark, sf_dir).select("doc_id", "text", (part != 0).alias("train"))
    found = lm_scoring.score(docs)
    held_out = F.coalesce(part == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", F.array_min("distances").alias("min_distance"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""

#: Shingle sets by definition: classes of equal sets, all pairs that share a shingle, and what links reach.
OP6_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM texts)),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM shingles GROUP BY doc_id),
classes AS MATERIALIZED (SELECT h, min(doc_id) AS c, max(n) AS n FROM sets GROUP BY h),
members AS MATERIALIZED (SELECT c, n, g FROM classes JOIN shingles ON doc_id = c),
pairs AS MATERIALIZED (
  SELECT a.c AS x, b.c AS y FROM members a JOIN members b ON a.g = b.g AND a.c < b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, links.y FROM reach JOIN links ON reach.r = links.x),
least AS (SELECT c, min(r) AS r FROM reach GROUP BY c)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(least.r, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN classes ON classes.h = sets.h LEFT JOIN least ON least.c = classes.c
"""

#: Each window of 50 words by its text, and each word that a repeated one covers.
OP7_SQL = r"""
WITH texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts)),
first AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN first USING (h) WHERE doc_id > lo),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_token_records": op3_token_records,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op6_ngram_join": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
}
