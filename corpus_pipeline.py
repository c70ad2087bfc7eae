"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, token records, one stage upon another.

Each stage is a function of (spark, docs, sf_dir); run() writes each stage's rows as Parquet in the shared folder and reads
them again as the next one's docs. All but the last give the columns of documents, in this order; extra columns are left out.

Nulls and odd rows: language ID drops null, empty and letterless texts. In the near-duplicate stage rows of one doc_id are
one document: all its distinct texts stay or go together, and of rows with equal doc_id and text (null doc_ids too) one stays; a null doc_id
links with nothing else. Decontamination keeps rows whatever their doc_id. The mix takes each row by itself, a null source being a
source of its own. Empty tables give empty tables in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import language_id, mixing
from eventloom.llm.common import executors_tidy, scratch_path, small_side, written
from eventloom.llm.decontaminate import decontaminate
from eventloom.llm.ngram_join import similar_components
from eventloom.llm.queries import END_ID, tokenizer_path
from eventloom.llm.token_records import with_starts, write_records

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without a letter, and those it can't tell."""
    return language_id.with_language(docs.select(*COLUMNS), language_id.fit(docs)).where("NOT rejected").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays."""
    docs = docs.select(*COLUMNS)
    found = similar_components(docs, n=5, percent=80)
    gone = written(found.where("component_id < doc_id").select("doc_id").distinct(), "near-duplicates")
    kept = docs.join(small_side(gone), "doc_id", "left_anti")
    # rows of one doc_id, and of none, come once for each of their texts
    again = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "repeated-ids")
    many = kept.join(small_side(again), kept["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    once = many.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row")).select("doc_id", "text", "row.*")
    return kept.join(small_side(again), kept["doc_id"].eqNullSafe(again["doc_id"]), "left_anti").select(*COLUMNS).union(once.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    found = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("item_ids") == 0).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    executors_tidy(spark)
    found = mixing.mixed(docs.select(*COLUMNS))
    return found.select(*COLUMNS, F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times"))).otherwise(F.array().cast("array<int>"))).alias("__copy")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all rows, with the place of each in its file and in the whole."""
    executors_tidy(spark)
    index = write_records(docs, scratch_path(spark, "records"), tokenizer_path(), END_ID)
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token records", token_stage),
]
#: Language ID and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
