import io
import struct
import zipfile
import zlib

import pytest

from quire.functions import arrow as A
from quire.pipeline import Config, Engine
from quire.sources import assemble_pages, formats, recognise
from quire.sources.formats import palmdoc, rtf_text


def pdf(text, compress=False):
    data = f"BT /F1 12 Tf 72 700 Td ({text}) Tj ET".encode()
    data, extra = (zlib.compress(data), b"/Filter /FlateDecode ") if compress else (data, b"")
    return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <<" + extra + b"/Length 1>>\nstream\n" + data + b"\nendstream endobj\n<</Title (My Title) /Author (Me)>>"


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = '<item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="gone.xhtml"/>'
        z.writestr("OPS/p.opf", f'<package xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator><dc:language>es</dc:language></metadata><manifest>{items}</manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="c"/><itemref idref="zz"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<html><body><p style='x'>first</p></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><h1>H</h1><script>no</script></body></html>")
    return out.getvalue()


def mobi(html):
    head = bytearray(200)
    struct.pack_into(">H", head, 0, 1)
    struct.pack_into(">I", head, 4, len(html))
    struct.pack_into(">H", head, 8, 1)
    head[16:20] = b"MOBI"
    struct.pack_into(">II", head, 84, 150, 4)
    head[150:154] = b"Name"
    struct.pack_into(">I", head, 100, 9)
    start = 78 + 16
    table = struct.pack(">II", start, 0) + struct.pack(">II", start + len(head), 0)
    front = bytearray(78)
    front[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", front, 76, 2)
    return bytes(front) + table + bytes(head) + html


def test_readers():
    assert formats.extract(b"a\n\nb <", "n.txt", ".TXT").html == "<article>\n<p>a</p>\n<p>b &lt;</p>\n</article>"
    d = formats.extract(epub(), "n.epub", ".epub")
    assert d.html == "<article>\n<section>\n<h1>H</h1>\n</section>\n<section>\n<p>first</p>\n</section>\n</article>"
    assert (d.title, d.author, d.language, d.warnings) == ("Book", "Ann", "es", ["Could not read spine item: gone.xhtml"])
    d = formats.extract(mobi(b"<html><body><p align=left>x</p></body></html>"), "n", ".azw3")
    assert (d.html, d.title, d.language, d.source_format) == ("<article>\n<p>x</p>\n</article>", "Name", "en", "azw3")
    for squeezed in (False, True):
        d = formats.extract(pdf("word " * 30, squeezed), "n.pdf", "pdf")
        assert "word word" in d.html and (d.title, d.author, d.page_count) == ("My Title", "Me", 1)


def test_rtf():
    assert rtf_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello \'e9\par Second \u8212? x\line y \{z\}}") == "Hello é\n\nSecond — x\ny {z}"
    assert formats.extract(b"{\\rtf1 }", "n", ".rtf").warnings


def test_palmdoc():
    assert palmdoc(b"abc") == b"abc"
    assert palmdoc(bytes([3, 200, 201, 202])) == bytes([200, 201, 202])
    assert palmdoc(b"abc" + bytes([0x80 | (3 << 3) >> 8, (3 << 3) & 0xFF | 0])) == b"abcabc"
    assert palmdoc(bytes([0xE1])) == b" a"


def test_errors():
    with pytest.raises(formats.UnsupportedFormat):
        formats.extract(b"x", "n.docx", ".docx")
    with pytest.raises(formats.ScannedPdf):
        formats.extract(b"%PDF-1.4 nothing", "n.pdf", ".pdf")
    with pytest.raises(formats.ExtractionError):
        formats.extract(b"PKbad", "n.epub", ".epub")
    assert formats.resolve(".bin", b"{\\rtf1") == "rtf"


def test_registering_a_reader():
    formats.register("csv", ("csv",))(lambda content, name, ext: formats.Document("<article></article>", source_format="csv"))
    assert formats.extract(b"", "x", "CSV").source_format == "csv"


class Provider:
    name = "echo"

    def initialize(self):
        self.open = True

    def recognize(self, image, number):
        if image == b"bad":
            raise ValueError("no")
        return image.decode() + " ", 50.0 if number == 2 else 90.0

    def terminate(self):
        self.open = False


def test_recognised_pages(spark):
    images = spark.createDataFrame([(1, 2, bytearray(b"two")), (1, 1, bytearray(b"one\n\nmore")), (1, 3, bytearray(b"bad")), (2, 1, bytearray(b"bad"))], "doc_id bigint, page_number int, image binary")
    pages = recognise(images, Provider)
    got = {r["doc_id"]: r for r in assemble_pages(pages).collect()}
    assert got[1]["html"] == '<article data-source="ocr" data-confidence="70.0">\n<section data-page="1">\n<p>one</p>\n<p>more</p>\n</section>\n<section data-page="2">\n<p>two</p>\n</section>\n</article>'
    assert (got[1]["ocr_confidence"], got[1]["low_confidence_pages"], got[1]["failed_pages"], got[2]["html"]) == (70.0, [2], 1, None)


@pytest.fixture()
def landing(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Chapter one of it\n\nThis is the first paragraph.\nIt goes on, by Jane Roe.\n\n42\n\nSECOND PART\n\nMore text here.")
    (folder / "b.html").write_text("<html lang=en><title>T</title><nav>x</nav><h1>One</h1><p>para<p>two</html>")
    (folder / "c.pdf").write_text("junk")
    (folder / "d.docx").write_text("other")
    return folder


def test_engine_on_files(spark, landing, tmp_path):
    engine = Engine(spark, Config("rag", formats=("md", "json", "jsonl", "txt", "odd")))
    result = engine.files(str(landing))
    assert [r["error_code"] for r in result.errors.collect()] == ["EXTRACTION_FAILED"]
    docs = {r["title"]: r for r in result.documents.collect()}
    assert set(docs) == {"a.txt", "T"} and docs["a.txt"]["author"].startswith("Jane Roe")
    assert [r["removed"] for r in result.audit.collect()] == ["42"]
    sections = result.sections.filter("title in ('SECOND PART')").first()
    assert (sections["id"], sections["parent_seq"], sections["chapter"]) == ("ch1-s1", 1, "Chapter one of it")
    assert all(0 <= r["overall"] <= 100 for r in result.scores.collect())
    assert len(engine.export(result, str(tmp_path / "out"))) == 4
    assert spark.read.json(str(tmp_path / "out/json")).count() == 2


def test_engine_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p>")], "doc_id bigint, html string")
    result = Engine(spark, Config("fine-tuning")).html(rows)
    assert result.documents.count() == 3 and result.chunks.count() == 1
    assert Engine(spark).html(rows.limit(0)).scores.count() == 0
    with pytest.raises(ValueError):
        Config("other")


def test_incremental_runs(spark, landing, tmp_path):
    from quire.streaming import process_new_files

    engine, seen = Engine(spark, Config("raw")), []
    run = lambda: process_new_files(engine, str(landing), str(tmp_path / "done"), str(tmp_path / "cp"), lambda r, n: seen.extend(x["title"] for x in r.documents.collect())).awaitTermination()
    run()
    assert sorted(seen) == ["T", "a.txt"]
    (landing / "copy.txt").write_bytes((landing / "a.txt").read_bytes())
    (landing / "new.txt").write_text("Fresh words.")
    run()
    assert sorted(seen) == ["T", "a.txt", "new.txt"]


def test_cache(spark, tmp_path):
    from quire.operators import cache

    store = cache.Cache(spark, str(tmp_path / "cache"))
    assert store.read() is None
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id int, content string")
    engine = Engine(spark)
    hit, todo = engine.cached_html(rows, store)
    assert (hit.count(), todo.count()) == (0, 2)
    store.add(todo.select("cache_key", "content"))
    hit, todo = engine.cached_html(rows.select("doc_id", "content"), store)
    assert todo.count() == 0




class Raster:
    def pages(self, content):
        yield from (b"First page of it.", b"two")
        if b"broken" in content:
            raise ValueError("no such page")


def test_scanned_files_are_read_by_the_providers(spark, landing):
    empty = b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n%%EOF"
    (landing / "scan.pdf").write_bytes(empty)
    (landing / "half.pdf").write_bytes(empty + b"broken")
    (landing / "book").write_bytes(b"{\\rtf1 Words of a file without extension.}")
    without = {r["path"].rsplit("/", 1)[1]: r["error_code"] for r in Engine(spark).files(str(landing)).errors.collect()}
    assert without == {"c.pdf": "EXTRACTION_FAILED", "scan.pdf": "SCANNED_PDF", "half.pdf": "SCANNED_PDF"}
    told = []
    result = Engine(spark, rasterizer=Raster, ocr=Provider, progress=lambda stage, share: told.append((stage, share))).files(str(landing))
    assert [r["error_code"] for r in result.errors.collect()] == ["EXTRACTION_FAILED"]
    docs = {r["title"]: r for r in result.documents.collect()}
    assert set(docs) == {"a.txt", "T", "scan.pdf", "half.pdf", "book"} and not docs["a.txt"]["is_scanned"]
    scan = docs["scan.pdf"]
    assert (scan["is_scanned"], scan["ocr_confidence"], scan["page_count"], scan["source_format"], scan["ocr_engine"]) == (True, 70.0, 2, "pdf", Provider.name)
    assert "First page of it." in scan["html"] and docs["half.pdf"]["page_count"] == 3
    assert told[-1] == ("sections", 1.0) and [s for _, s in told] == sorted(s for _, s in told)


def test_sql_names(spark):
    A.register_sql(spark)
    row = spark.sql("select count_tokens('One 12345, two'), detect_language('the board of the archive keeps all of it for the people who read there'), detect_language('x'), count_tokens(null)").first()
    assert tuple(row) == (5, "en", "unknown", None)
    assert formats.supported() == sorted(formats.supported()) and ".pdf" in formats.supported()
    assert A.fix_recognised("irmãdo fãdo")["text"] == "irmãão fãão"


def test_staged_tables_are_released(spark):
    from quire.plans import release, staged

    release(spark)
    rows = staged(spark.range(5), "t")
    assert rows.count() == 5 and release(spark) == 1 and release(spark) == 0
