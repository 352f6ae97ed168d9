"""Scores of documents: structure, chunk consistency, metadata, overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.constants import CHUNK_MAX, CHUNK_MIN
from quire.functions.text import rounded


def completeness(title: Column, author: Column, language: Column, source_format: Column) -> Column:
    """Share of filled metadata fields in percent."""
    filled = sum(F.when(c.isNotNull() & (c != ""), 1).otherwise(0) for c in (title, author, language))
    filled = filled + F.when(source_format.isNotNull() & ~source_format.isin("", "unknown"), 1).otherwise(0)
    return rounded(filled / 4 * 100)


def structure_score(preserved: Column, scanned: Column, depth: Column) -> Column:
    kept = F.when(F.coalesce(scanned, F.lit(False)), preserved * 0.6).otherwise(preserved)
    return F.least(rounded(kept * 0.8 + F.least(F.coalesce(depth, F.lit(1)) * 10, F.lit(20))), F.lit(100))


def chunk_measures(chunks: DataFrame, key: str, tokens: str = "token_count", overlap: str = "overlap_tokens", least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> DataFrame:
    """(key, n_chunks, consistency, with_chapter, with_section) by document; null counts are taken as 0."""
    size = F.coalesce(F.col(tokens), F.lit(0)) - F.coalesce(F.col(overlap), F.lit(0))
    mean = F.avg(size)
    penalty = F.least(F.when(mean > 0, F.stddev_pop(size) / mean).otherwise(0.0) * 50, F.lit(30.0))
    inside = F.avg(size.between(least, most).cast("int")) * 100
    filled = lambda c: F.avg(F.when(F.col(c).isNotNull() & (F.col(c) != ""), 1.0).otherwise(0.0))
    return chunks.groupBy(key).agg(
        F.count("*").alias("n_chunks"),
        F.greatest(F.lit(0), F.least(F.lit(100), rounded(inside - penalty))).cast("bigint").alias("consistency"),
        filled("chapter").alias("with_chapter"),
        filled("section").alias("with_section"),
    )


def metadata_score(title: Column, author: Column, language: Column, n_chunks: Column, with_chapter: Column, with_section: Column, complete: Column, confidence: Column) -> Column:
    got = sum(F.when(c.isNotNull() & (c != ""), 1).otherwise(0) for c in (title, author, language))
    by_chunks = F.when(with_chapter > 0.5, 1).otherwise(0) + F.when(with_section > 0.3, 1).otherwise(0)
    got = got + F.when(F.coalesce(n_chunks, F.lit(0)) > 0, by_chunks).otherwise(F.when(complete > 50, 1).otherwise(0))
    base = rounded(got / 5 * 100)
    return F.when(confidence > 80, F.least(F.lit(100), base + 5)).when(confidence < 60, F.greatest(F.lit(0), base - 10)).otherwise(base)


def overall(structure: Column, consistency: Column, metadata: Column) -> Column:
    return rounded(structure * 0.4 + F.coalesce(consistency, F.lit(50)) * 0.3 + metadata * 0.3)
