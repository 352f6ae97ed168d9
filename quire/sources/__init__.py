"""Sources: files of ten extensions as rows of extracted documents, and recognised pages."""

from quire.sources.files import extract_files, extracted, read_files
from quire.sources.formats import register, supported
from quire.sources.ocr import OcrProvider, Rasterizer, assemble_pages, rasterise, recognise

__all__ = ["OcrProvider", "Rasterizer", "assemble_pages", "extract_files", "extracted", "rasterise", "read_files", "recognise", "register", "supported"]
