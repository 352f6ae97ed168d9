"""Exports: Markdown, JSON, JSONL and plain text as one string for each document, and their writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.arrow import one_decimal


def _ordered(rows: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(rows)), lambda x: x["s"])


def provenance(scanned: Column, engine: Column, confidence: Column) -> Column:
    share = F.coalesce(one_decimal(confidence), F.lit("N/A"))
    return F.when(F.coalesce(scanned, F.lit(False)), F.concat(F.lit("Extracted via OCR ("), F.coalesce(engine, F.lit("unknown")), F.lit(", confidence: "), share, F.lit("%)")))


def markdown_head(m: dict[str, Column], with_metadata: bool = True) -> Column:
    """Title, metadata block and provenance note."""
    filled = lambda c: c.isNotNull() & (c != "")
    parts = [F.when(filled(m["title"]), F.concat(F.lit("# "), m["title"], F.lit("\n\n"))).otherwise("")]
    scanned = F.coalesce(m["is_scanned"], F.lit(False))
    if with_metadata:
        parts.append(F.lit("---\n"))
        for name, c in (("author", m["author"]), ("language", m["language"]), ("source", m["source_format"])):
            parts.append(F.when(filled(c), F.concat(F.lit(f"{name}: "), c, F.lit("\n"))).otherwise(""))
        engine, share = F.coalesce(m["ocr_engine"], F.lit("unknown")), F.coalesce(one_decimal(m["ocr_confidence"]), F.lit("N/A"))
        parts.append(F.when(scanned, F.concat(F.lit("ocr_engine: "), engine, F.lit("\nocr_confidence: "), share, F.lit("%\n"))).otherwise(""))
        parts.append(F.lit("---\n\n"))
    note = provenance(m["is_scanned"], m["ocr_engine"], m["ocr_confidence"])
    parts.append(F.when(note.isNotNull(), F.concat(F.lit("> *"), note, F.lit("*\n\n"))).otherwise(""))
    return F.concat(*parts)


def section_markdown(sections: DataFrame, key: str) -> DataFrame:
    """(key, body): the content of sections in order; blank ones leave nothing."""
    body = F.concat(X.trim(F.col("content")), F.lit("\n\n"))
    some = sections.filter(X.trim(F.col("content")) != "")
    return some.groupBy(key).agg(F.array_join(_ordered(F.struct("seq", body.alias("s"))), "").alias("body"))


def section_text(sections: DataFrame, key: str) -> DataFrame:
    """(key, body): plain text of sections in order, each under its title unless it is Document."""
    title = F.when(F.col("title").isNotNull() & ~F.col("title").isin("", "Document"), F.concat("title", F.lit("\n\n"))).otherwise("")
    piece = F.concat(title, X.strip_markdown(F.coalesce("content", F.lit(""))), F.lit("\n\n"))
    joined = F.array_join(_ordered(F.struct("seq", piece.alias("s"))), "")
    return sections.groupBy(key).agg(F.concat(X.trim(joined), F.lit("\n")).alias("body"))


def jsonl_record(title: Column, with_metadata: bool = True, confidence: Column | None = None) -> Column:
    """One line for a chunk; null fields are left out."""
    fields = [F.col("content").alias("text"), "chunk_id", F.col("token_count")]
    if with_metadata:
        fields.append(F.struct(title.alias("title"), "chapter", "section", F.struct("index", "total").alias("position")).alias("metadata"))
    if confidence is not None:
        fields.append(confidence.alias("ocr_confidence"))
    return F.to_json(F.struct(*fields))


def stats(chunks: DataFrame, key: str, tokens: str = "token_count") -> DataFrame:
    """(key, total_chunks, total_tokens, avg_chunk_size)."""
    n = F.coalesce(F.col(tokens), F.lit(0))
    return chunks.groupBy(key).agg(F.count("*").alias("total_chunks"), F.sum(n).cast("bigint").alias("total_tokens"), X.rounded(F.avg(n)).cast("bigint").alias("avg_chunk_size"))


# ---- writers, by format ----------------------------------------------------------------------------


def _texts(column: str) -> Callable[[DataFrame, str], None]:
    def write(df: DataFrame, path: str) -> None:
        df.select("doc_id", "slug", column).write.mode("overwrite").parquet(path)

    return write


EXPORTERS: dict[str, Callable[[DataFrame, str], None]] = {
    "md": _texts("markdown"),
    "txt": _texts("plain"),
    "jsonl": lambda df, path: df.select("line").write.mode("overwrite").text(path),
    "json": lambda df, path: df.write.mode("overwrite").json(path),
}


def register_exporter(name: str, writer: Callable[[DataFrame, str], None]) -> None:
    EXPORTERS[name] = writer


def export(frames: dict[str, DataFrame], path: str, formats: list[str]) -> list[str]:
    """Write each known format below ``path``; unknown ones are passed over.  Returns the folders written."""
    out = []
    for name in formats:
        if name in EXPORTERS and name in frames:
            EXPORTERS[name](frames[name], f"{path}/{name}")
            out.append(f"{path}/{name}")
    return out
