"""Readers of single files: bytes to the HTML dialect with metadata, warnings and an error code.

``EXTRACTORS`` maps a format to a reader; ``register`` adds or replaces one.  A reader gets the bytes
and the file's name and extension and returns a ``Document``; what it raises becomes the row's error.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

from quire.functions.constants import FORMATS, LOCALES
from quire.functions.html import DROPPED, standard_html


class ExtractionError(Exception):
    code = "EXTRACTION_FAILED"
    recoverable = False


class ScannedPdf(ExtractionError):
    code = "SCANNED_PDF"
    recoverable = True


class UnsupportedFormat(ExtractionError):
    code = "UNSUPPORTED_FORMAT"


@dataclass
class Document:
    html: str
    title: str | None = None
    author: str | None = None
    language: str | None = None
    page_count: int | None = None
    source_format: str = "unknown"
    warnings: list[str] = field(default_factory=list)


Reader = Callable[[bytes, str, str], Document]
EXTRACTORS: dict[str, Reader] = {}


def register(format_: str, extensions: tuple[str, ...] = ()) -> Callable[[Reader], Reader]:
    """Make a function the reader of a format, and extensions name that format."""

    def add(reader: Reader) -> Reader:
        EXTRACTORS[format_] = reader
        FORMATS.update(dict.fromkeys((e if e.startswith(".") else "." + e for e in map(str.lower, extensions)), format_))
        return reader

    return add


def resolve(extension: str, content: bytes) -> str:
    """The format that the extension names, else the one that the first bytes show."""
    e = extension.lower()
    known = FORMATS.get(e if e.startswith(".") else "." + e)
    if known:
        return known
    if content[:4] == b"%PDF":
        return "pdf"
    if content[:2] == b"PK":
        return "epub"
    if content[:5] == b"{\\rtf":
        return "rtf"
    if len(content) >= 68 and content[60:68] in (b"BOOKMOBI", b"TEXtREAd"):
        return "mobi"
    raise UnsupportedFormat(f"unknown format {extension!r}")


def supported() -> list[str]:
    """The known extensions, sorted."""
    return sorted(FORMATS)


def extract(content: bytes, name: str, extension: str) -> Document:
    return EXTRACTORS[resolve(extension, content)](content, name, extension)


def paragraphs(text: str) -> str:
    parts = (p.strip() for p in re.split(r"\n\s*\n", text))
    escaped = (p.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for p in parts if p)
    return "\n".join(f"<p>{p}</p>" for p in escaped)


def article(inner: str) -> str:
    return f"<article>\n{inner}\n</article>"


@register("txt")
def read_text(content: bytes, name: str, extension: str) -> Document:
    return Document(article(paragraphs(content.decode("utf-8", "replace"))), title=name, source_format="txt")


@register("html")
def read_html(content: bytes, name: str, extension: str) -> Document:
    inner, title, author, language = standard_html(content.decode("utf-8", "replace"))
    return Document(article(inner), title or name, author, language, source_format="html", warnings=[] if inner else ["HTML document produced no extractable content"])


# ---- RTF -------------------------------------------------------------------------------------------

SKIPPED_GROUPS = set("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr".split())
CONTROLS = {"par": "\n\n", "pard": "\n\n", "line": "\n", "softline": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "'", "rquote": "'", "ldblquote": '"', "rdblquote": '"', "bullet": "•"}
RTF_TOKEN = re.compile(r"(?P<open>\{(?:\\(?P<group>[a-z]+))?)|(?P<close>\})|\\(?:u(?P<code>-?\d+)\??|'(?P<hex>[0-9a-fA-F]{2})|(?P<plain>[\\{}])|(?P<word>[a-z]+)-?\d*\s?|(?P<other>.))|(?P<text>[^\\{}\r\n]+)|[\r\n]", re.S)


def rtf_text(source: str) -> str:
    """The text of RTF: tokens of a pattern, and a stack that says which groups are left out."""
    out, stack, skip = [], [], False
    at = 0
    while at < len(source):
        m = RTF_TOKEN.match(source, at)
        if not m:
            break
        at = m.end()
        if m["open"] is not None:
            stack.append(skip)
            skip = skip or m["group"] in SKIPPED_GROUPS
            if m["group"]:
                at = m.start() + 1  # the word is read as a token of its own
        elif m["close"]:
            skip = stack.pop() if stack else False
        elif skip:
            continue
        elif m["code"]:
            if int(m["code"]) >= 0:
                out.append(chr(int(m["code"])))
        elif m["hex"]:
            out.append(chr(int(m["hex"], 16)))
        elif m["plain"] or m["text"]:
            out.append(m["plain"] or m["text"])
        elif m["word"]:
            out.append(CONTROLS.get(m["word"], ""))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


@register("rtf")
def read_rtf(content: bytes, name: str, extension: str) -> Document:
    text = rtf_text(content.decode("latin-1"))
    return Document(article(paragraphs(text)), title=name, source_format="rtf", warnings=[] if text else ["RTF document produced no extractable text"])


# ---- EPUB ------------------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


@register("epub")
def read_epub(content: bytes, name: str, extension: str) -> Document:
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        root = next((e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile"), None)
        if not root:
            raise ExtractionError("no rootfile in the container")
        package = ElementTree.fromstring(book.read(root))
    except ExtractionError:
        raise
    except Exception as e:
        raise ExtractionError(f"EPUB: {e}") from e
    first: dict[str, str] = {}
    for e in package.iter():
        if _local(e.tag) in ("title", "creator", "language") and (e.text or "").strip():
            first.setdefault(_local(e.tag), e.text)
    manifest = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item" and e.get("id") and e.get("href")}
    spine = [manifest[e.get("idref")] for e in package.iter() if _local(e.tag) == "itemref" and e.get("idref") in manifest]
    warnings = [] if spine else ["No spine items found in EPUB"]
    folder, parts = root.rpartition("/")[0], []
    for href in spine:
        try:
            source = book.read(f"{folder}/{href}" if folder else href).decode("utf-8", "replace")
        except KeyError:
            warnings.append(f"Could not read spine item: {href}")
            continue
        inner = standard_html(source, {"script", "style"})[0]
        if inner:
            parts.append(f"<section>\n{inner}\n</section>")
    return Document(article("\n".join(parts)), first.get("title") or name, first.get("creator"), first.get("language"), source_format="epub", warnings=warnings)


# ---- MOBI ------------------------------------------------------------------------------------------


def palmdoc(data: bytes) -> bytes:
    """PalmDOC decompression, as published: literals, copies of 1-8 bytes, back references, a space with a character."""
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        i += 1
        if 1 <= b <= 8:
            out += data[i : i + b]
            i += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((0x20, b ^ 0x80))
        elif i < len(data):
            pair = (b << 8 | data[i]) & 0x3FFF
            i += 1
            back, size = pair >> 3, (pair & 7) + 3
            for _ in range(size):
                if 0 < back <= len(out):
                    out.append(out[-back])
    return bytes(out)


#: Fields of the first record: offset and layout (fixed values of the format).
MOBI_FIELDS = {"compression": (0, ">H"), "length": (4, ">I"), "texts": (8, ">H"), "title at": (84, ">I"), "title size": (88, ">I"), "locale": (100, ">I")}
EXTH_AUTHOR = 100


def _mobi_records(content: bytes) -> list[bytes]:
    """The records of a Palm database: a count at 76, then entries of eight bytes that begin with an offset."""
    if len(content) < 78:
        raise ExtractionError("file too small")
    (many,) = struct.unpack_from(">H", content, 76)
    edges = [at for at, _ in struct.iter_unpack(">II", content[78 : 78 + 8 * many])] + [len(content)]
    return [content[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _mobi_fields(head: bytes) -> dict[str, int]:
    named = head[16:20] == b"MOBI" and len(head) >= 132
    return {n: struct.unpack_from(layout, head, at)[0] for n, (at, layout) in MOBI_FIELDS.items() if at < 16 or named}


def _exth(head: bytes):
    """(kind, value) of the extended header's entries, as far as they are whole."""
    _, found, rest = head.partition(b"EXTH")
    many, rest = (int.from_bytes(rest[4:8]), rest[8:]) if found and len(rest) >= 8 else (0, b"")
    while many and len(rest) >= 8:
        kind, size = struct.unpack_from(">II", rest)
        if not 8 <= size <= len(rest):
            return
        yield kind, rest[8:size]
        many, rest = many - 1, rest[size:]


@register("mobi")
def read_mobi(content: bytes, name: str, extension: str) -> Document:
    try:
        head, *texts = _mobi_records(content)
        fields = _mobi_fields(head)
        texts = texts[: fields["texts"]]
        source = b"".join(map(palmdoc, texts) if fields["compression"] == 2 else texts)[: fields["length"]]
    except ExtractionError:
        raise
    except Exception as e:
        raise ExtractionError(f"MOBI: {e}") from e
    at, size = fields.get("title at", 0), fields.get("title size", 0)
    title = head[at : at + size].decode("utf-8", "replace") if at + size <= len(head) else None
    author = next((v.decode("utf-8", "replace") for k, v in reversed([*_exth(head)]) if k == EXTH_AUTHOR), None)
    inner = standard_html(source.decode("utf-8", "replace"), {"script", "style", "mbp:pagebreak", "mbp:nu", "mbp:section"}, ("style", "class", "align", "width", "height"))[0]
    return Document(article(inner), title or name, author, LOCALES.get(fields.get("locale", 0) & 0xFF), source_format=extension.lower().lstrip(".") or "mobi", warnings=[] if inner else ["MOBI document produced no extractable content"])


# ---- PDF -------------------------------------------------------------------------------------------

LEAST_CHARS = 50  # characters a page, under which a PDF is scanned; under twice as many it is thin
PDF_STRING = rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def pdf_text(content: bytes) -> tuple[list[str], dict[str, str]]:
    """(text of content streams, information entries): literal strings of text operators, plain or deflated streams."""
    texts = []
    for m in re.finditer(rb"<<(?P<dict>.*?)>>\s*stream\r?\n(?P<data>.*?)\r?\n?endstream", content, re.S):
        data = m["data"]
        if b"FlateDecode" in m["dict"]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        lines = []
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            line = ""
            for op in re.finditer(rb"(?P<list>\[(?:[^\]\\]|\\.)*\])\s*TJ|(?P<one>" + PDF_STRING + rb")\s*(?:Tj|'|\")|(?P<new>T\*|\bTd\b|\bTD\b|\bTm\b)", block, re.S):
                if op["new"]:
                    line += "\n" if line and not line.endswith("\n") else ""
                else:
                    line += "".join(_pdf_string(x) for x in re.findall(PDF_STRING, op["list"] or op["one"], re.S))
            lines.append(line)
        if lines:
            texts.append("\n".join(lines))
    info = {k.decode(): _pdf_string(v) for k, v in re.findall(rb"/(Title|Author)\s*(" + PDF_STRING + rb")", content, re.S)}
    return texts, info


@register("pdf")
def read_pdf(content: bytes, name: str, extension: str) -> Document:
    if content[:4] != b"%PDF":
        raise ExtractionError("not a PDF")
    pages = max(1, len(re.findall(rb"/Type\s*/Page\b(?!s)", content)))
    texts, info = pdf_text(content)
    text = "\n\n".join(texts).strip()
    density = len(text) / pages
    if density < LEAST_CHARS:
        raise ScannedPdf(f"PDF appears to be scanned ({density:.0f} characters a page)")
    warnings = [f"Low text density: {density:.0f} chars/page"] if density < 2 * LEAST_CHARS else []
    return Document(article(paragraphs(text)), info.get("Title") or name, info.get("Author"), None, pages, "pdf", warnings)


__all__ = ["DROPPED", "EXTRACTORS", "Document", "ExtractionError", "ScannedPdf", "UnsupportedFormat", "extract", "register", "resolve", "supported"]
