"""Files as rows: binary scan, format resolution, extraction with one error per row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.constants import FORMATS
from quire.sources import formats

METADATA = "title string, author string, language string, page_count int, is_scanned boolean, source_format string, ocr_confidence double, ocr_engine string, low_confidence_pages array<int>"
RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("html", "title", "author", "language")]
    + [T.StructField("page_count", T.IntegerType()), T.StructField("source_format", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))]
    + [T.StructField("error_code", T.StringType()), T.StructField("error_message", T.StringType())]
)


def read_files(spark: SparkSession, path: str, recursive: bool = False, glob: str | None = None, sniff: bool = False) -> DataFrame:
    """(path, name, extension, size, sha256, content): the files below a folder that have a known extension.

    Files of unknown extension are kept too where ``glob`` names them, or, with ``sniff``, where their first bytes show
    a known format.  The filter comes before any Python; without ``sniff`` other files are not read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    if not glob:
        shown = format_of(F.lit(""), F.decode(F.substring("content", 1, 68), "ISO-8859-1")).isNotNull()
        files = files.filter(extension.isin(*FORMATS) | shown if sniff else extension.isin(*FORMATS))
    return files.select("path", name.alias("name"), extension.alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def format_of(extension: Column, magic: Column) -> Column:
    """The format by extension, else by the first bytes (as a Latin-1 string); null where neither shows one."""
    named = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    lower = F.lower(extension)
    with_dot = F.when(lower.startswith("."), lower).otherwise(F.concat(F.lit("."), lower))
    sniffed = (
        F.when(magic.startswith("%PDF"), "pdf")
        .when(magic.startswith("PK"), "epub")
        .when(magic.startswith("{\\rtf"), "rtf")
        .when(F.substring(magic, 61, 8).isin("BOOKMOBI", "TEXtREAd") & (F.length(magic) >= 68), "mobi")
    )
    return F.coalesce(F.try_element_at(named, with_dot), sniffed)


@F.arrow_udf(RESULT)
def _extract(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = [f.name for f in RESULT.fields]
    kind = pa.struct([(n, pa.int32() if n == "page_count" else pa.list_(pa.string()) if n == "warnings" else pa.string()) for n in names])
    for contents, file_names, extensions in batches:
        out = []
        for content, name, extension in zip(contents.to_pylist(), file_names.to_pylist(), extensions.to_pylist(), strict=True):
            try:
                d = formats.extract(content or b"", name, extension or "")
                out.append({"html": d.html, "title": d.title, "author": d.author, "language": d.language, "page_count": d.page_count, "source_format": d.source_format, "warnings": d.warnings, "error_code": None, "error_message": None})
            except formats.ExtractionError as e:
                out.append(dict.fromkeys(names) | {"warnings": [], "error_code": e.code, "error_message": str(e)})
            except Exception as e:  # one file must not end the job
                out.append(dict.fromkeys(names) | {"warnings": [], "error_code": "EXTRACTION_FAILED", "error_message": f"{type(e).__name__}: {e}"})
        yield pa.array(out, kind)


def extract_files(files: DataFrame) -> DataFrame:
    """``files`` with the fields of the extraction; rows that fail have error_code and no html."""
    got = files.withColumn("_x", _extract.asNondeterministic()("content", "name", "extension"))
    return got.select(*[c for c in files.columns if c != "content"], "_x.*")


def extracted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with an error) of an extraction."""
    return files.filter("error_code is null"), files.filter("error_code is not null")
