"""Recognised pages: a provider run over page images, and documents assembled from page rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.arrow import one_decimal
from quire.functions.constants import LOW_CONFIDENCE

PAGES = "doc_id bigint, page_number int, text string, confidence double, warnings array<string>"


class OcrProvider(Protocol):
    name: str

    def initialize(self) -> None: ...
    def recognize(self, image: bytes, page_number: int) -> tuple[str, float]: ...
    def terminate(self) -> None: ...


class Rasterizer(Protocol):
    def pages(self, content: bytes) -> Iterator[bytes]: ...


def rasterise(files: DataFrame, provider: Callable[[], Rasterizer]) -> DataFrame:
    """(doc_id, page_number, image) of (doc_id, content); one page at a time, as page images are large.

    A file whose pages cannot be read has one row of a null image, for the page where it fails.
    """

    def images(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = provider()
        for frame in frames:
            for doc, content in zip(frame["doc_id"], frame["content"], strict=True):
                number = 0
                try:
                    for number, image in enumerate(engine.pages(content), 1):
                        yield pd.DataFrame({"doc_id": [doc], "page_number": [number], "image": [image]})
                except Exception:
                    yield pd.DataFrame({"doc_id": [doc], "page_number": [number + 1], "image": [None]})

    return files.select("doc_id", "content").mapInPandas(images, "doc_id bigint, page_number int, image binary")


def recognise(images: DataFrame, provider: Callable[[], OcrProvider], threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Page rows of (doc_id, page_number, image); one provider for each task, one row for each page.

    A page that fails has null text and a warning; low confidence and empty text are warned of.
    """

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = provider()
        engine.initialize()
        try:
            for frame in frames:
                rows = []
                for doc, number, image in zip(frame["doc_id"], frame["page_number"], frame["image"], strict=True):
                    try:
                        text, sure = engine.recognize(image, number)
                        text = text.strip()
                        warnings = [f"Low confidence on page {number}: {sure:.1f}"] if sure < threshold else []
                        warnings += [] if text else [f"No text on page {number}"]
                        rows.append((doc, number, text, float(sure), warnings))
                    except Exception as e:
                        rows.append((doc, number, None, None, [f"OCR failed for page {number}: {e}"]))
                yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "confidence", "warnings"])
        finally:
            engine.terminate()

    return images.select("doc_id", "page_number", "image").mapInPandas(pages, PAGES)


def assemble_pages(pages: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """(doc_id, html, page_count, ocr_confidence, low_confidence_pages, failed_pages): one document of its pages.

    Pages of null text failed and stay out; the confidence is the mean of the others (nulls do not count);
    repeated pages appear once.  A document whose pages all failed has null html.
    """
    rows = pages.select("doc_id", "page_number", "text", "confidence").dropDuplicates()
    body = F.array_join(F.transform(X.paragraphs(F.col("text")), lambda p: F.concat(F.lit("<p>"), X.escape(p), F.lit("</p>"))), "\n")
    section = F.concat(F.lit('<section data-page="'), F.col("page_number"), F.lit('">\n'), body, F.lit("\n</section>"))
    good = F.col("text").isNotNull()
    found = rows.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(good, F.struct("page_number", section.alias("s"))))), lambda x: x["s"]), "\n").alias("_body"),
        F.count("*").alias("page_count"),
        F.avg(F.when(good, F.col("confidence"))).alias("ocr_confidence"),
        F.sort_array(F.collect_set(F.when(good & (F.col("confidence") < threshold), F.col("page_number")))).alias("low_confidence_pages"),
        F.sum((~good).cast("bigint")).alias("failed_pages"),
    )
    head = F.concat(F.lit('<article data-source="ocr" data-confidence="'), one_decimal(F.coalesce("ocr_confidence", F.lit(0.0))), F.lit('">\n'))
    html = F.when(F.col("failed_pages") < F.col("page_count"), F.concat(head, F.col("_body"), F.lit("\n</article>")))
    return found.select("doc_id", html.alias("html"), "page_count", "ocr_confidence", "low_confidence_pages", "failed_pages")
