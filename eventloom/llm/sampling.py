"""Seeded, bounded samples of labelled rows: the same rows at every run, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def per_class(rows: DataFrame, label: str, key: str, most: int, seed: int, classes: int = 1000) -> tuple[DataFrame, dict]:
    """Of each label, about `most` rows at most by the hash of key (hard bound: twice that); and how many rows each label has.

    More than `classes` labels are an error: labels are to be few.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(classes + 1).collect()}
    if len(counts) > classes:
        raise ValueError(f"more than {classes} values of {label}")
    if not counts:
        return rows.limit(0), counts
    place = F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit((1 << 53) - 1))
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    return rows.where(place < share * float(1 << 53)).limit(2 * most * len(counts)), counts
