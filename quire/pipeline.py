"""The whole pipeline: files or extracted HTML to documents, sections, chunks, scores and exports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import arrow as A
from quire.functions import text as X
from quire.functions.constants import PRESETS
from quire.operators import cache, chunking, export, quality, structure
from quire.plans import ship, spread, staged
from quire.sources import extract_files, extracted, read_files
from quire.sources.ocr import assemble_pages, rasterise, recognise


@dataclass(frozen=True)
class Config:
    """A preset with what may differ from it; unknown presets and levels raise."""

    preset: str = "rag"
    cleaning: str | None = None
    formats: tuple[str, ...] | None = None
    chunks: chunking.ChunkOptions = field(default_factory=chunking.ChunkOptions)
    keep_preamble: bool = False

    def __post_init__(self):
        if self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset!r}; there are {', '.join(PRESETS)}")
        if self.level not in X.LEVELS:
            raise ValueError(f"unknown cleaning level {self.level!r}")

    @property
    def level(self) -> str:
        return self.cleaning or PRESETS[self.preset]["cleaning"]

    @property
    def export_formats(self) -> list[str]:
        return list(self.formats or PRESETS[self.preset]["formats"])

    @property
    def with_metadata(self) -> bool:
        return self.preset != "fine-tuning"

    def options(self) -> dict:
        return {"level": self.level, "version": 1}


@dataclass
class Result:
    documents: DataFrame
    audit: DataFrame
    headings: DataFrame
    sections: DataFrame
    chunks: DataFrame
    scores: DataFrame
    errors: DataFrame | None = None


#: What a document row has besides its key and html.
FIELDS = {
    "title": "string", "author": "string", "language": "string", "page_count": "int", "is_scanned": "boolean", "source_format": "string",
    "ocr_confidence": "double", "ocr_engine": "string",
}


class Engine:
    """Runs a configuration; results are DataFrames keyed by ``doc_id``, computed up to the sections when asked for.

    ``rasterizer`` and ``ocr`` make the providers that read scanned PDFs; without them these end as errors.
    ``progress`` is called with a stage's name and the share that is done.
    """

    def __init__(self, spark: SparkSession, config: Config = Config(), rasterizer=None, ocr=None, progress: Callable[[str, float], None] = lambda stage, share: None):
        self.spark, self.config, self.rasterizer, self.ocr, self.progress = ship(spark), config, rasterizer, ocr, progress

    def files(self, path: str, recursive: bool = False) -> Result:
        """All known files of a folder, known by extension or first bytes; files that cannot be read are in ``errors``, never fatal."""
        rows = spread(read_files(self.spark, path, recursive, sniff=True))
        good, bad = extracted(staged(extract_files(rows), "extracted"))
        self.progress("extracted", 0.3)
        good = good.withColumn("doc_id", F.xxhash64("path")).withColumn("is_scanned", F.lit(False))
        if self.rasterizer and self.ocr:
            pages, bad = self.scanned(rows, bad)
            good = good.unionByName(pages, allowMissingColumns=True)
        result = self.html(good)
        result.errors = bad.select("path", "error_code", "error_message")
        return result

    def scanned(self, rows: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents of scanned files, errors that are left): those of ``bad`` that the providers can read."""
        some = rows.join(bad.filter(F.col("error_code") == "SCANNED_PDF").select("path"), "path", "left_semi").withColumn("doc_id", F.xxhash64("path"))
        read = staged(assemble_pages(recognise(rasterise(some, self.rasterizer), self.ocr)).filter("html is not null"), "recognised")
        named = bad.withColumn("doc_id", F.xxhash64("path"))
        pages = named.drop("html", "page_count", "source_format", "error_code", "error_message").join(read, "doc_id")
        engine = getattr(self.ocr, "name", None) or getattr(self.ocr, "__name__", "ocr")
        pages = pages.drop("failed_pages").withColumns({"title": F.coalesce("title", "name"), "source_format": F.lit("pdf"), "is_scanned": F.lit(True), "ocr_engine": F.lit(engine)})
        return pages, named.join(read.select("doc_id"), "doc_id", "left_anti")

    def html(self, rows: DataFrame) -> Result:
        """Documents of (doc_id, html) and any of the metadata fields; missing ones are null.

        Null html passes as a document without sections.  Rows of one doc_id count as one document, so give
        distinct keys.
        """
        c = self.config
        have = set(rows.columns)
        docs = rows.select("doc_id", "html", *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])
        # recognised text is mended first; the split keeps other rows out of Python
        scanned = F.coalesce("is_scanned", F.lit(False))
        fixed = docs.filter(scanned).withColumn("html", A.fix_ocr("html")["text"])
        docs = docs.filter(~scanned).unionByName(fixed)
        docs = docs.withColumn("html", X.normalize(F.col("html"), A.nfc))
        docs = staged(docs, "normalised")
        self.progress("normalised", 0.5)
        patterns = self._patterns(docs) if c.level != "light" else None
        if patterns is not None:
            docs = docs.join(patterns, "doc_id", "left")
        texts = F.coalesce("_patterns", F.array().cast("array<string>")) if patterns is not None else None
        cleaned = docs.withColumn("_before", F.col("html")).withColumn("html", X.clean(F.col("html"), c.level, texts))
        audit = cleaned.select("doc_id", F.explode(X.audit(F.col("_before"), c.level, texts)).alias("a")).select("doc_id", "a.*")
        cleaned = staged(cleaned.drop("_before", "_patterns"), "cleaned")
        self.progress("cleaned", 0.7)

        cut = structure.blocks(cleaned, "doc_id", "html")
        found = structure.headings(cut, "doc_id")
        spans = structure.sections(cut, "doc_id", c.keep_preamble)
        tree = structure.section_tree(spans.withColumnsRenamed({"seq": "ordinal", "title": "text"}), "doc_id")
        tree = tree.withColumn("content", A.html_to_markdown("html")).withColumn("m", X.section_measures(F.col("content")))
        sections = tree.select("doc_id", "seq", "id", "level", F.col("text").alias("title"), "content", "parent_seq", "depth", "chapter", "section", "m.*")
        sections = staged(sections, "sections")
        self.progress("sections", 1.0)

        detected = X.language_scores(F.col("html"))["language"]
        first = sections.filter("seq = 1").select("doc_id", F.col("title").alias("_first"))
        documents = cleaned.join(first, "doc_id", "left").withColumn("_detected", detected)
        documents = documents.select(
            "doc_id", F.coalesce(F.nullif("title", F.lit("")), "_first").alias("title"), F.coalesce(F.nullif("author", F.lit("")), X.author_of(F.col("html"))).alias("author"),
            F.when(F.col("_detected") != "unknown", F.col("_detected")).otherwise(F.col("language")).alias("language"),
            F.coalesce("source_format", F.lit("unknown")).alias("source_format"), "page_count", "is_scanned", "ocr_confidence", "ocr_engine", "html",
        )
        chapter = F.when(F.col("level") == 1, F.col("title")).otherwise(F.when(F.col("parent_seq").isNotNull() | (F.col("chapter") != F.col("title")), F.col("chapter")))
        blocks = sections.select("doc_id", "seq", "content", chapter.alias("chapter"), F.when(F.col("level") >= 2, F.col("title")).alias("section"))
        chunks = chunking.chunks(blocks, "doc_id", c.chunks)
        return Result(documents, audit, found, sections, chunks, self._scores(documents, found, sections, chunks))

    def _patterns(self, docs: DataFrame) -> DataFrame:
        found = structure.repeated_blocks(docs, "doc_id", "html").filter("confidence >= 0.5")
        order = F.struct((-F.col("confidence")).alias("c"), F.col("positions")[0].alias("p"), "text")
        return found.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]).alias("_patterns"))

    def _scores(self, documents: DataFrame, found: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
        o = self.config.chunks
        rows = documents.join(structure.indicators(found, "doc_id"), "doc_id", "left")
        rows = rows.join(sections.groupBy("doc_id").agg(F.max("depth").alias("depth")), "doc_id", "left")
        rows = rows.join(quality.chunk_measures(chunks, "doc_id", least=o.min_tokens, most=o.max_tokens), "doc_id", "left")
        x = {n: F.col(n) for n in rows.columns}
        preserved = F.coalesce("structure_preserved", F.lit(30))
        whole = quality.completeness(x["title"], x["author"], x["language"], x["source_format"])
        rows = rows.select(
            "doc_id", preserved.alias("structure_preserved"), F.lit(50).alias("noise_removed"), whole.alias("metadata_completeness"),
            quality.structure_score(preserved, x["is_scanned"], x["depth"]).alias("structure"), F.coalesce("consistency", F.lit(50)).alias("chunk_consistency"),
            quality.metadata_score(x["title"], x["author"], x["language"], x["n_chunks"], x["with_chapter"], x["with_section"], whole, x["ocr_confidence"]).alias("metadata"),
        )
        return rows.withColumn("overall", quality.overall(F.col("structure"), F.col("chunk_consistency"), F.col("metadata")))

    def export(self, result: Result, path: str) -> list[str]:
        """Writes the configured formats below ``path``, each as one folder of rows or lines."""
        docs, c = result.documents, self.config
        named = docs.select("doc_id", X.slug(F.col("title")).alias("slug"), *FIELDS)
        head = export.markdown_head({n: F.col(n) for n in FIELDS}, c.with_metadata)
        md = named.join(export.section_markdown(result.sections, "doc_id"), "doc_id", "left").select("doc_id", "slug", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))
        note = export.provenance(F.col("is_scanned"), F.col("ocr_engine"), F.col("ocr_confidence"))
        note = F.when(note.isNotNull(), F.concat(F.lit("["), note, F.lit("]\n\n"))).otherwise("")
        txt = named.join(export.section_text(result.sections, "doc_id"), "doc_id", "left").select("doc_id", "slug", F.concat(note, F.coalesce("body", F.lit("\n"))).alias("plain"))
        title = docs.select("doc_id", F.col("title").alias("_title"), F.when(F.coalesce("is_scanned", F.lit(False)), F.col("ocr_confidence")).alias("_sure"))
        lines = result.chunks.join(title, "doc_id", "left").select(export.jsonl_record(F.col("_title"), c.with_metadata, F.col("_sure")).alias("line"))
        children = result.sections.filter("parent_seq is not null").groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count("*").alias("child_count"))
        top = result.sections.filter("parent_seq is null").join(children, ["doc_id", "seq"], "left").groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("seq", "id", "title", "level", "word_count", "char_count", F.coalesce("child_count", F.lit(0)).alias("child_count")))).alias("sections")
        )
        gathered = result.chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "chunk_id", "content", "chapter", "section", "token_count", "overlap_tokens", "total"))).alias("chunks"))
        whole = named.join(result.scores, "doc_id", "left").join(gathered, "doc_id", "left")
        whole = whole.join(top, "doc_id", "left") if c.with_metadata else whole
        return export.export({"md": md, "txt": txt, "jsonl": lines, "json": whole}, path, c.export_formats)

    def cached_html(self, rows: DataFrame, store: cache.Cache) -> tuple[DataFrame, DataFrame]:
        """(rows that the cache has with their results, rows still to do) of (doc_id, content)."""
        keyed = rows.withColumn("cache_key", cache.key_of(F.col("content"), self.config.options()))
        have = store.read()
        if have is None:
            return keyed.limit(0), keyed.dropDuplicates(["cache_key"])
        return cache.hits(keyed, have), cache.misses(keyed, have)
