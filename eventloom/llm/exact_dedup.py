"""Exact dedup by content-defined chunk recipes, with DataFrame functions alone.

A text is cut where its own content says so, so that equal passages give equal chunks wherever they stand. Chunks are
deduplicated to identifiers: the hash of a chunk, verified by comparing the distinct chunk texts of each hash; chunks that
share a hash get a rank besides. A document's recipe is its ordered list of identifiers, made where its text already
is; texts are equal when their recipes are. Distinct chunks are shuffled once; whole texts never are.

Nulls: a null text is empty, and empty texts are equal. A null doc_id is below every other. Rows repeated with one
doc_id all belong to the group and are marked kept alike. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A chunk ends after a line end, stop or bar whose three characters before fall in these classes: about one in a thousand.
CUT = r"(?<=[acegikmoqsuwy\x{80}-\x{10FFFF}][a-hknr\x{80}-\x{10FFFF}][abdhnty\x{80}-\x{10FFFF}][.\n|])"
#: Characters of a chunk at most; a longer one is cut at this length from its own start.
CHUNK = 4096


def folded(text: Column) -> Column:
    """text, null as empty, with A-Z and no other letter in lower case."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bounded(pieces: Column, most: int = CHUNK) -> Column:
    """pieces, with those over `most` characters cut at that length from their own start."""
    parts = F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= most, F.array(p)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, most)))))
    return F.when(F.exists(pieces, lambda p: F.length(p) > most), parts).otherwise(pieces)


def recipes(docs: DataFrame, cut: str = CUT, most: int = CHUNK, hash_bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and recipe (array of verified identifiers) of every row of docs (doc_id, text).

    hash_bits: below 64 hashes collide on purpose, for tests of the verification.
    """
    low = F.lit((1 << hash_bits) - 1 if hash_bits < 64 else -1)
    ident = lambda c: F.xxhash64(c).bitwiseAND(low)
    base = docs.select("doc_id", folded(F.col("text")).alias("__norm"))
    # the cut pieces are a column of their own, and explode_outer infers no filter: either would make them more than once
    cuts = base.select("doc_id", "__norm", F.split("__norm", cut).alias("__pieces")).select("doc_id", F.sha2("__norm", 256).alias("text_sha256"), bounded(F.col("__pieces"), most).alias("__chunks"))
    cuts = written(cuts, "chunks", "zstd")
    distinct = cuts.select(F.explode_outer("__chunks").alias("chunk")).select(ident(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "chunk-clashes")
    plain = cuts.select("doc_id", "text_sha256", F.transform("__chunks", lambda c: ident(c)).alias("recipe"), "__chunks")
    if shared.isEmpty():
        return plain.drop("__chunks")
    ranked = distinct.join(small_side(shared), "h").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("rank"))
    numbered = plain.withColumn("__row", F.monotonically_increasing_id())
    spots = numbered.select("__row", F.posexplode("__chunks").alias("pos", "chunk")).withColumn("h", ident(F.col("chunk"))).join(small_side(shared), "h", "left_semi")
    ranks = spots.join(ranked, ["h", "chunk"]).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    lists = F.coalesce(F.transform("ranks", lambda r: r["rank"].cast("long")), F.array().cast("array<long>"))
    return numbered.drop("__chunks").join(ranks, "__row", "left").select("doc_id", "text_sha256", F.concat("recipe", lists).alias("recipe"))


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: of equal texts the largest doc_id stays."""
    made = written(recipes(docs.select("doc_id", "text"), **options), "recipes")
    groups = made.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = written(groups, "recipe-groups")
    return made.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
        "text_sha256",
    )
