"""Queries of the library's own operators over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import arrow as A
from quire.functions import text as X
from quire.operators import cache, chunking, export, quality, structure
from quire.plans import read_table, spread
from quire.sources.files import format_of
from quire.sources.ocr import assemble_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---- inputs ----------------------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text"))


def text_html(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", X.text_to_html(F.col("text")).alias("html"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "extraction_results").select("extraction_id", "html").dropDuplicates(["extraction_id"])


def sections(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "sections").dropDuplicates(["section_key"])


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunks").dropDuplicates(["chunk_key"])


def metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "document_metadata")
    names = ["title", "author", "language", "page_count", "is_scanned", "source_format", "ocr_confidence", "ocr_engine"]
    last = rows.groupBy("doc_id").agg(F.max(F.struct("updated_at", *names)).alias("m"))
    return last.select("doc_id", *[F.col(f"m.{n}").alias(n) for n in names])


# ---- values of the SQL, apart from those of the operators ------------------------------------------

ALLOWED_TAGS = "article section div h1 h2 h3 h4 h5 h6 p span em strong a ul ol li table thead tbody tr th td pre code blockquote br hr".split()
FORMATS = dict(x.split("=") for x in ".pdf=pdf .epub=epub .txt=txt .text=txt .html=html .htm=html .rtf=rtf .mobi=mobi .azw=mobi .azw3=mobi".split())
STOPWORDS = {
    "en": "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me".split(),
    "pt": "de a o que e do da em um para com no na uma os se mais as dos como mas foi ao ele das tem seu sua ou ser quando muito nos ja eu tambem so pelo pela ate isso ela entre era depois sem mesmo aos ter seus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante todos uno les ni".split(),
}
PREFIXES = ("ch", "s", "ss", "p", "sp", "ssp")

# ---- parts of SQL ----------------------------------------------------------------------------------

NL = "chr(10)"
WS_ = X.WS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rr(value: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({value}, {q(pattern)}, {q(to)}, {q(flags)})"


def trim_(value: str) -> str:
    return rr(value, f"^{WS_}+|{WS_}+$")


def html_(text: str = "text") -> str:
    esc = "replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    parts = f"list_filter(list_transform(string_split_regex({text}, {q(chr(92) + 'n' + WS_ + '*' + chr(92) + 'n')}), lambda p: {trim_('p')}), lambda p: p <> '')"
    return f"'<article>' || {NL} || array_to_string(list_transform({parts}, lambda p: '<p>' || {esc} || '</p>'), {NL}) || {NL} || '</article>'"


HTML = f"(SELECT doc_id, {html_()} AS html FROM documents)"
PAGES = "(SELECT DISTINCT extraction_id, html FROM extraction_results)"
SECTIONS = "(SELECT DISTINCT ON (section_key) * FROM sections)"
CHUNKS = "(SELECT DISTINCT ON (chunk_key) * FROM chunks)"
METADATA = "(SELECT doc_id, m.* FROM (SELECT doc_id, max(struct_pack(updated_at := updated_at, title := title, author := author, language := language, page_count := page_count, is_scanned := is_scanned, source_format := source_format, ocr_confidence := ocr_confidence, ocr_engine := ocr_engine)) AS m FROM document_metadata GROUP BY doc_id))"
NEWEST = """(SELECT * FROM document_metadata QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated_at DESC, title DESC NULLS LAST,
  author DESC NULLS LAST, language DESC NULLS LAST, page_count DESC NULLS LAST, is_scanned DESC NULLS LAST, source_format DESC NULLS LAST,
  ocr_confidence DESC NULLS LAST, ocr_engine DESC NULLS LAST) = 1)"""


def typography_(v: str) -> str:
    for chars, to in (("[‘’‚‛]", "'"), ("[“”„‟]", '"'), ("[–—]", "-"), ("…", "..."), (" ", " ")):
        v = rr(v, chars, to)
    return v


def dehyphenate_(v: str) -> str:
    return rr(v, r"(\p{L})-\s*\n\s*(\p{L})", r"\1\2")


def unwrap_(v: str) -> str:
    return rr(v, r"([\p{L},;.!?:)])\s*\n\s*([\p{L}(])", r"\1 \2")


# The SQL has its own values, written from the rules and not taken from the operators.
PAGE_ = (r"(?i)<p[^>]*>\s*-?\s*[0-9]{1,4}\s*-?\s*</p>", r"(?i)<p[^>]*>\s*(page|p\.?|pg\.?)\s*[0-9]{1,4}(\s*(of|/)\s*[0-9]{1,4})?\s*</p>")
ISBN_ = r"ISBN[- \t\n]?(13|10)?[\s:]*([0-9][-\s]?){9,13}[0-9Xx]"
LEGAL_ = tuple(rf"(?i)<p[^>]*>[^<]*({x})[^<]*</p>" for x in (r"copyright|©|\(c\)", r"all\s+rights\s+reserved", r"published\s+by", r"printed\s+in"))
DECORATIVE_ = r"(?i)<p[^>]*>\s*[-*=_~#]{3,}\s*</p>"


def page_numbers_(v: str) -> str:
    return rr(rr(v, PAGE_[0]), PAGE_[1])


def legal_(v: str) -> str:
    for p in LEGAL_:
        v = rr(v, p)
    return v


def empty_(v: str) -> str:
    return rr(v, r"(?i)<p[^>]*>\s*</p>|<section[^>]*>\s*</section>|<div[^>]*>\s*</div>")


def orphan_(v: str) -> str:
    """The list of paragraphs that are orphans: short, with a digit, of at most four characters, and no capital with three more."""
    text = "trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
    short = f"regexp_extract_all({v}, {q(r'(?i)<p[^>]*>' + chr(92) + 's*[^<]{1,10}' + chr(92) + 's*</p>')})"
    return f"list_filter({short}, lambda x: length({text}) BETWEEN 1 AND 4 AND regexp_matches({text}, '[0-9]') AND NOT (length({text}) > 3 AND regexp_matches({text}, '^[A-Z]')))"


def clean_(v: str, level: str) -> str:
    v = rr(page_numbers_(v), r"\n{3,}", "\n\n")
    if level != "light":
        v = legal_(rr(v, ISBN_))
    if level == "aggressive":
        v = rr(f"list_reduce(list_prepend({v}, {orphan_(v)}), lambda h, x: replace(h, x, ''))", DECORATIVE_)
    return empty_(v)


def words_(v: str) -> str:
    return f"list_filter(string_split_regex({v}, {q(WS_ + '+')}), lambda w: w <> '')"


def language_(v: str) -> str:
    """en, pt, es, language, confidence over a subselect's list column ``w``."""
    share = {k: f"len(list_filter(w, lambda x: list_contains([{', '.join(map(q, s))}], x)))::DOUBLE / len(w)" for k, s in STOPWORDS.items()}
    inner = ", ".join(f"CASE WHEN len(w) < 10 THEN 0.0 ELSE {e} END AS {k}" for k, e in share.items())
    return f"SELECT doc_id, len(w) < 10 AS few, {inner} FROM (SELECT doc_id, {words_('lower(' + rr(v, '<[^>]+>') + ')')} AS w FROM documents)"


LANGUAGES = f"""(SELECT doc_id, en, pt, es, CASE WHEN few OR best < 0.02 OR best - second < 0.01 THEN 'unknown'
  WHEN en = best THEN 'en' WHEN pt = best THEN 'pt' ELSE 'es' END AS language, best AS confidence
  FROM (SELECT *, greatest(en, pt, es) AS best, list_sort([en, pt, es], 'DESC')[2] AS second FROM ({language_('text')})))"""


# ---- sources ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {html_()} AS html FROM documents")
def q_txt_to_html(spark, d):
    return text_html(spark, d)


_format_case = " ".join(f"WHEN ext = {q(k)} THEN {q(v)}" for k, v in FORMATS.items())


@query(f"""SELECT doc_id, source_format, CASE {_format_case} END AS format
  FROM (SELECT DISTINCT doc_id, source_format, CASE WHEN lower(source_format) LIKE '.%' THEN lower(source_format) ELSE '.' || lower(source_format) END AS ext FROM document_metadata)""")
def q_format_resolve(spark, d):
    rows = read_table(spark, d, "document_metadata").select("doc_id", "source_format").distinct()
    return rows.select("doc_id", "source_format", format_of(F.col("source_format"), F.lit("")).alias("format"))


@query("""SELECT name, CASE WHEN name = 'a' THEN 'pdf' WHEN name = 'b' THEN 'epub' WHEN name = 'c' THEN 'rtf' WHEN name = 'd' THEN 'mobi' END AS format
  FROM (VALUES ('a'), ('b'), ('c'), ('d'), ('e'), ('f')) t(name)""")
def q_format_by_magic(spark, d):
    rows = [("a", "%PDF-1.4"), ("b", "PK\3\4"), ("c", "{\\rtf1 x}"), ("d", "x" * 60 + "BOOKMOBI"), ("e", "x" * 59 + "BOOKMOBI"), ("f", "plain text")]
    return spark.createDataFrame(rows, "name string, magic string").select("name", format_of(F.lit(".bin"), F.col("magic")).alias("format"))


@query(r"""SELECT doc_id, string_agg(href, '|' ORDER BY pos) AS hrefs FROM (
  SELECT s.doc_id, s.seq AS pos, m.href FROM (SELECT DISTINCT doc_id, seq, id FROM sections) s
  JOIN (SELECT DISTINCT doc_id, id, 'text/' || id || '.xhtml' AS href FROM sections WHERE level <= 2) m USING (doc_id, id)) GROUP BY doc_id""")
def q_spine_join(spark, d):
    rows = read_table(spark, d, "sections").select("doc_id", "seq", "id", "level")
    manifest = rows.filter("level <= 2").select("doc_id", "id", F.concat(F.lit("text/"), "id", F.lit(".xhtml")).alias("href")).distinct()
    spine = rows.select("doc_id", "seq", "id").distinct().join(manifest, ["doc_id", "id"])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "href"))), lambda x: x["href"])
    return spine.groupBy("doc_id").agg(F.array_join(listed, "|").alias("hrefs"))


# ---- the HTML dialect ------------------------------------------------------------------------------


@query(f"""SELECT extraction_id, array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains([{', '.join(map(q, ALLOWED_TAGS))}], x))), ',') AS invalid, len(list_filter(t, lambda x: NOT list_contains([{', '.join(map(q, ALLOWED_TAGS))}], x))) = 0 AS valid
  FROM (SELECT extraction_id, list_distinct(list_transform(regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9]*)\\b[^>]*>', 1), lambda x: lower(x))) AS t FROM {PAGES})""")
def q_validate_tags(spark, d):
    bad = X.invalid_tags(F.col("html"))
    return pages(spark, d).select("extraction_id", F.array_join(bad, ",").alias("invalid"), (F.size(bad) == 0).alias("valid"))


@query(f"""SELECT extraction_id, {rr("replace(replace(html, '<h2>', '<mark>'), '</h2>', '</mark>')", "(?i)</?mark[^>]*>")} AS html FROM {PAGES}""")
def q_strip_tags(spark, d):
    marked = F.replace(F.replace(F.col("html"), F.lit("<h2>"), F.lit("<mark>")), F.lit("</h2>"), F.lit("</mark>"))
    return pages(spark, d).select("extraction_id", X.strip_disallowed(marked).alias("html"))


# ---- normalising -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {typography_('text')} AS text FROM documents")
def q_normalize_typography(spark, d):
    return documents(spark, d).select("doc_id", X.typography(F.col("text")).alias("text"))


@query(f"SELECT page_key, {dehyphenate_('text')} AS text FROM (SELECT DISTINCT page_key, text FROM ocr_pages)")
def q_normalize_dehyphenate(spark, d):
    return read_table(spark, d, "ocr_pages").select("page_key", "text").distinct().select("page_key", X.dehyphenate(F.col("text")).alias("text"))


@query(f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(html, '<p>[^<]*</p>'), lambda p: {unwrap_('p')}), chr(10)) AS html FROM {HTML}")
def q_normalize_unwrap(spark, d):
    joined = F.regexp_extract_all(X.unwrap(F.col("html")), F.lit("<p>[^<]*</p>"), 0)
    return text_html(spark, d).select("doc_id", F.array_join(joined, "\n").alias("html"))


@query(r"SELECT doc_id, regexp_replace(chr(7) || text || chr(127), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS text FROM documents")
def q_normalize_controls(spark, d):
    return documents(spark, d).select("doc_id", X.strip_controls(F.concat(F.lit("\x07"), "text", F.lit("\x7f"))).alias("text"))


@query(f"""SELECT doc_id, {rr(rr(rr("replace(text, '. ', '.   ')", "  +", " "), "(?m) +$"), " +(</(?:p|article)>)", chr(92) + "1")} AS text FROM documents""")
def q_collapse_spaces(spark, d):
    wide = F.replace(F.col("text"), F.lit(". "), F.lit(".   "))
    return documents(spark, d).select("doc_id", X.trim_lines(X.collapse_spaces(wide)).alias("text"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def q_normalize_nfc(spark, d):
    return documents(spark, d).select("doc_id", A.nfc("text").alias("text"))


# ---- cleaning --------------------------------------------------------------------------------------


#: One piece of noise of each kind, and what only looks like noise.
NOISE = """<p>42</p>
<p>- 7 -</p>
<p>Page 3 of 9</p>



<p>ISBN 978-3-16-148410-0</p>
<p>Copyright 2020</p>
<p>All rights reserved.</p>
<p>x 1</p>
<p>x1   </p>
<p>A123</p>
<p>B747</p>
<p>Ab12</p>
<p>A12</p>
<p>***</p>
<p>Running head</p>
<p>Text</p>
<p>Running head</p>
<div> </div>
"""


def _noisy(html):
    """The documents' HTML with noise before, so that every rule has work."""
    return F.concat(F.lit(NOISE), html)


_noise_sql = " || chr(10) || ".join(q(x) for x in NOISE.split("\n")) + " || html"


def _clean_query(level: str):
    def f(spark, d):
        return text_html(spark, d).select("doc_id", X.clean(_noisy(F.col("html")), level).alias("html"))

    f.__name__ = f"q_clean_{level}"
    query(f"SELECT doc_id, {clean_(_noise_sql, level)} AS html FROM {HTML}")(f)


for _level in X.LEVELS:
    _clean_query(_level)


def _count_(v: str, p: str) -> str:
    return f"len(regexp_extract_all({v}, {q(p)}))"


_after_pages = rr(page_numbers_("h"), r"\n{3,}", "\n\n")
_after_heads = f"replace({_after_pages}, 'Running head', '')"
_after_legal = legal_(rr(_after_heads, ISBN_))
_legal_counts, _text = [], rr(_after_heads, ISBN_)
for _p in LEGAL_:
    _legal_counts.append(_count_(_text, _p))
    _text = rr(_text, _p)
_noisy_html = f"(SELECT {_noise_sql} AS h FROM {HTML})"


@query(f"""SELECT type, sum(n)::BIGINT AS n FROM (
  SELECT 'page_number' AS type, {_count_('h', PAGE_[0])} + {_count_(rr('h', PAGE_[0]), PAGE_[1])} AS n FROM {_noisy_html}
  UNION ALL SELECT 'whitespace', CASE WHEN {_after_pages} <> {page_numbers_('h')} THEN 1 ELSE 0 END FROM {_noisy_html}
  UNION ALL SELECT 'repeated_pattern', (length({_after_pages}) - length({_after_heads})) / length('Running head') FROM {_noisy_html}
  UNION ALL SELECT 'isbn', {_count_(_after_heads, ISBN_)} FROM {_noisy_html}
  UNION ALL SELECT 'legal_credit', {' + '.join(_legal_counts)} FROM {_noisy_html}
  UNION ALL SELECT 'orphan_paragraph', len({orphan_('l')}) FROM (SELECT {_after_legal} AS l FROM {_noisy_html})
  UNION ALL SELECT 'decorative', {_count_('l', DECORATIVE_)} FROM (SELECT {_after_legal} AS l FROM {_noisy_html})) GROUP BY type HAVING sum(n) > 0""")
def q_audit_counts(spark, d):
    rows = text_html(spark, d).select(F.explode(X.audit(_noisy(F.col("html")), "aggressive", F.array(F.lit("Running head")))).alias("a"))
    return rows.groupBy("a.type").agg(F.count("*").alias("n"))


#: A running line three times, twice in another case, so that something repeats on every page.
_again = "<p>Shelf list of the archive</p>\n<div>SHELF LIST of the archive</div>\n<p>Shelf list of the archive</p>\n"
_again_sql = "replace(html, '<article>', '<article>' || " + " || chr(10) || ".join(q(x) for x in _again.split("\n")) + ")"


def _with_again(html):
    return F.replace(html, F.lit("<article>"), F.lit("<article>" + _again))


REPEATED = f"(SELECT extraction_id, {_again_sql} AS html FROM {PAGES})"
_blocks_sql = f"""SELECT extraction_id, unnest(list_zip(range(1, 1 + len(l)), l)) AS b FROM (SELECT extraction_id, list_transform(regexp_extract_all(html, '(?i)<(?:p|div|span)[^>]*>([^\\n]*?)</(?:p|div|span)>', 1), lambda x: {trim_(rr('x', '<[^>]+>'))}) AS l FROM {REPEATED})"""


@query(f"""WITH b AS (SELECT extraction_id, b[1] AS pos, b[2] AS text FROM ({_blocks_sql}) WHERE length(b[2]) BETWEEN 1 AND 199)
  SELECT extraction_id, arg_min(text, pos) AS text, count(*) AS n, count(*)::DOUBLE / max(total) AS confidence FROM (SELECT *, count(*) OVER (PARTITION BY extraction_id) AS total FROM b)
  GROUP BY extraction_id, lower(text) HAVING count(*) >= 3""")
def q_repeated_patterns(spark, d):
    return structure.repeated_blocks(pages(spark, d).withColumn("html", _with_again(F.col("html"))), "extraction_id", "html").select("extraction_id", "text", "n", "confidence")


@query(f"""WITH b AS (SELECT extraction_id, b[1] AS pos, b[2] AS text FROM ({_blocks_sql}) WHERE length(b[2]) BETWEEN 1 AND 199),
  r AS (SELECT extraction_id, arg_min(text, pos) AS text FROM (SELECT *, count(*) OVER (PARTITION BY extraction_id) AS total FROM b) GROUP BY extraction_id, lower(text) HAVING count(*) >= 3 AND count(*)::DOUBLE / max(total) >= 0.2)
  SELECT p.extraction_id, length(list_reduce(list_prepend(p.html, coalesce(r.l, []::VARCHAR[])), lambda h, t: replace(h, t, '')))::BIGINT AS n FROM {REPEATED} p LEFT JOIN (SELECT extraction_id, list(text) AS l FROM r GROUP BY extraction_id) r USING (extraction_id)""")
def q_remove_repeated(spark, d):
    rows = pages(spark, d).withColumn("html", _with_again(F.col("html")))
    found = structure.repeated_blocks(rows, "extraction_id", "html").filter("confidence >= 0.2").groupBy("extraction_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "text"))).alias("r"))
    texts = F.coalesce(F.transform("r", lambda x: x["text"]), F.array().cast("array<string>"))
    return rows.join(found, "extraction_id", "left").select("extraction_id", F.length(X.without_patterns(F.col("html"), texts)).cast("bigint").alias("n"))


# ---- language --------------------------------------------------------------------------------------


@query(f"SELECT doc_id, en, pt, es, language, confidence FROM {LANGUAGES}")
def q_language_scores(spark, d):
    return documents(spark, d).select("doc_id", X.language_scores(F.col("text")).alias("l")).select("doc_id", "l.*")


@query(f"SELECT lang, language, count(*) AS n FROM {LANGUAGES} JOIN documents USING (doc_id) GROUP BY lang, language")
def q_language_vs_label(spark, d):
    rows = spread(read_table(spark, d, "documents").select("lang", "text")).select("lang", X.language_scores(F.col("text"))["language"].alias("language"))
    return rows.groupBy("lang", "language").agg(F.count("*").alias("n"))


# ---- the flagship ----------------------------------------------------------------------------------

_profile_html = rr(unwrap_(dehyphenate_(typography_("html"))), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


@query(f"""SELECT h.doc_id, l.language, len(regexp_extract_all(c, '<p>'))::BIGINT AS n_paragraphs, len({words_(rr('c', '<[^>]+>', ' '))})::BIGINT AS n_words, (len(regexp_extract_all(h.n, '<p>')) - len(regexp_extract_all(c, '<p>')))::BIGINT AS n_removed
  FROM (SELECT doc_id, n, {clean_('n', 'standard')} AS c FROM (SELECT doc_id, {_profile_html} AS n FROM (SELECT doc_id, {_noise_sql} AS html FROM {HTML}))) h
  JOIN {LANGUAGES} l USING (doc_id)""")
def q_slice_doc_profile(spark, d):
    rows = documents(spark, d).select("doc_id", X.language_scores(F.col("text"))["language"].alias("language"), _noisy(X.text_to_html(F.col("text"))).alias("html"))
    plain = X.strip_controls(X.dehyphenate(X.typography(F.col("html"))))
    plain = F.regexp_replace(plain, r"([\p{L},;.!?:)])\s*\n\s*([\p{L}(])", "$1 $2")
    rows = rows.select("doc_id", "language", plain.alias("n")).withColumn("c", X.clean(F.col("n"), "standard"))
    count = lambda c: F.regexp_count(c, F.lit("<p>"))
    return rows.select("doc_id", "language", count(F.col("c")).cast("bigint").alias("n_paragraphs"), F.size(X.words(F.regexp_replace("c", "<[^>]+>", " "))).cast("bigint").alias("n_words"), (count(F.col("n")) - count(F.col("c"))).cast("bigint").alias("n_removed"))


# ---- headings and sections -------------------------------------------------------------------------

_roman, _letter = r"(?i)^[IVXLCDM]+\.\s", r"^[a-zA-Z][.)]\s"
_title_sql = "CASE WHEN regexp_matches(text, '(?i)^(?:part|parte)\\s+') OR regexp_matches(text, '(?i)^(?:chapter|cap[ií]tulo)\\s+') THEN 1 WHEN regexp_matches(text, '(?i)^(?:section|se[çc][ãa]o)\\s+') OR regexp_matches(text, '(?i)^(?:appendix|ap[êe]ndice)\\s+') THEN 2 END"
_number_sql = f"CASE WHEN regexp_matches(text, '^\\d+(?:\\.\\d+)*\\.\\s') THEN least(len(string_split(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\.\\s', 1), '.')), 6) WHEN regexp_matches(text, {q(_roman)}) THEN 1 WHEN regexp_matches(text, {q(_letter)}) THEN 3 END"
_shout_sql = "length(text) < 100 AND upper(text) = text AND regexp_matches(text, '[A-Z]')"
#: The pages' HTML with headings of every source between.
_extra = "<p>1.2. Numbered part</p>\n<p>IV. Roman part</p>\n<p>b) Lettered part</p>\n<p>Chapter nine of it</p>\n<p>SHOUTED LINE</p>\n<p>Capítulo dez</p>\n"


def _with_extra(html):
    return F.replace(html, F.lit("</article>"), F.lit(_extra + "</article>"))


_extra_sql = "replace(html, '</article>', " + " || chr(10) || ".join(q(x) for x in _extra.split("\n")) + " || '</article>')"
_cut_sql = f"""SELECT extraction_id, list_filter(string_split(regexp_replace(regexp_replace(h, '(?i)(<h[1-6][^>]*>|<p[^>]*>)', chr(1) || '\\1', 'g'), '(?i)(</h[1-6]>|</p>)', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l
  FROM (SELECT extraction_id, {_extra_sql} AS h FROM {PAGES})"""
_block_sql = f"""SELECT extraction_id, pos, raw, CASE WHEN regexp_matches(raw, '(?i)^<h[1-6][^>]*>[^\\n]*</h[1-6]>$') THEN 'h' WHEN regexp_matches(raw, '(?i)^<p[^>]*>[^\\n]*</p>$') THEN 'p' ELSE 'other' END AS kind,
  {trim_(rr("regexp_extract(raw, '(?i)^<(?:h[1-6]|p)[^>]*>([^" + chr(92) + "n]*)</(?:h[1-6]|p)>$', 1)", "<[^>]+>"))} AS text FROM (SELECT extraction_id, b[1] AS pos, b[2] AS raw FROM (SELECT extraction_id, unnest(list_zip(range(len(l)), l)) AS b FROM ({_cut_sql})))"""
_heading_sql = f"""SELECT * FROM (SELECT extraction_id, pos, text, kind,
  CASE WHEN kind = 'h' THEN regexp_extract(raw, '(?i)^<h([1-6])', 1)::INT WHEN kind = 'p' AND length(text) <= 200 THEN coalesce({_title_sql}, {_number_sql}, CASE WHEN {_shout_sql} THEN 2 END) END AS level,
  CASE WHEN kind = 'h' THEN 'html-tag' WHEN {_title_sql} IS NOT NULL THEN 'linguistic' WHEN {_number_sql} IS NOT NULL THEN 'numbering' ELSE 'uppercase' END AS source
  FROM ({_block_sql}) WHERE text <> '') WHERE level IS NOT NULL"""
_sure_sql = "CASE source WHEN 'html-tag' THEN 1.0 WHEN 'linguistic' THEN 0.8 WHEN 'numbering' THEN 0.7 ELSE 0.5 END::DOUBLE"


def _cut(spark, d) -> DataFrame:
    return structure.blocks(pages(spark, d).withColumn("html", _with_extra(F.col("html"))), "extraction_id", "html")


@query(f"SELECT extraction_id, row_number() OVER (PARTITION BY extraction_id ORDER BY pos) AS ordinal, level, text, source, {_sure_sql} AS confidence FROM ({_heading_sql})")
def q_headings(spark, d):
    return structure.headings(_cut(spark, d), "extraction_id").drop("pos")


_lines_sql = "SELECT DISTINCT trim(x) AS text FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(trim(x)) BETWEEN 1 AND 200"


def _lines(spark, d) -> DataFrame:
    rows = documents(spark, d).select(F.explode(F.split("text", "\n")).alias("x")).select(F.trim("x").alias("text"))
    return rows.filter(F.length("text").between(1, 200)).distinct()


@query(f"SELECT text, {_number_sql} AS level FROM ({_lines_sql}) WHERE {_number_sql} IS NOT NULL")
def q_heading_numbering(spark, d):
    return _lines(spark, d).select("text", structure.numbered_level(F.col("text")).alias("level")).filter("level is not null")


@query(f"SELECT text, {_title_sql} AS level FROM (SELECT 'Chapter ' || text AS text FROM ({_lines_sql}) UNION ALL SELECT 'apêndice ' || text FROM ({_lines_sql})) WHERE {_title_sql} IS NOT NULL")
def q_heading_linguistic(spark, d):
    rows = _lines(spark, d)
    both = rows.select(F.concat(F.lit("Chapter "), "text").alias("text")).unionByName(rows.select(F.concat(F.lit("apêndice "), "text").alias("text")))
    return both.select("text", structure.titled_level(F.col("text")).alias("level")).filter("level is not null")


@query(f"SELECT text, ({_shout_sql}) AND text NOT LIKE '%ß%' AS shouted FROM (SELECT upper(replace(text, 'ß', 'SS')) AS text FROM ({_lines_sql}) UNION ALL SELECT text FROM ({_lines_sql}))")
def q_heading_uppercase(spark, d):
    rows = _lines(spark, d)
    both = rows.select(F.upper("text").alias("text")).unionByName(rows)
    return both.select("text", structure.shouted(F.col("text")).alias("shouted"))


def _levels(spark, d) -> DataFrame:
    return read_table(spark, d, "sections").select("doc_id", F.col("seq").alias("ordinal"), "level", F.col("title").alias("text")).distinct()


_ids = ", ".join(f"count(*) FILTER (level = {k}) OVER (PARTITION BY doc_id, g{k} ORDER BY seq) AS n{k}" for k in range(1, 7))
_gs = ", ".join(f"count(*) FILTER (level < {k}) OVER (PARTITION BY doc_id ORDER BY seq) AS g{k}, max(CASE WHEN level = {k} THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p{k}" for k in range(1, 7))
_name = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN level >= {k} AND n{k} > 0 THEN '{p}' || n{k} END" for k, p in enumerate(PREFIXES, 1)) + "], lambda x: x IS NOT NULL), '-')"
_parent = "greatest(" + ", ".join(f"CASE WHEN level > {k} THEN p{k} END" for k in range(1, 6)) + ")"
_depth = " + ".join(f"CASE WHEN level > {k} AND p{k} > greatest(-1{''.join(f', coalesce(p{j}, -1)' for j in range(1, k))}) THEN 1 ELSE 0 END" for k in range(1, 6))


@query(f"""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS seq, level, text FROM (SELECT DISTINCT doc_id, seq AS ordinal, level, title AS text FROM sections)),
  g AS (SELECT *, {_gs} FROM h), n AS (SELECT *, {_ids} FROM g)
  SELECT doc_id, seq, {_name} AS id, {_parent} AS parent_seq, 1 + {_depth} AS depth,
  coalesce(last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), text) AS chapter, CASE WHEN level = 2 THEN text END AS section FROM n""")
def q_section_tree(spark, d):
    return structure.section_tree(_levels(spark, d), "doc_id").select("doc_id", "seq", "id", "parent_seq", "depth", "chapter", "section")


@query(f"""WITH b AS (SELECT * FROM ({_block_sql})), h AS (SELECT * FROM ({_heading_sql})),
  s AS (SELECT b.extraction_id, b.pos, b.raw, h.level, h.text AS title, count(h.level) OVER (PARTITION BY b.extraction_id ORDER BY b.pos) AS seq FROM b LEFT JOIN h ON b.extraction_id = h.extraction_id AND b.pos = h.pos)
  SELECT extraction_id, seq, max(level) AS level, max(title) AS title, length({trim_("coalesce(string_agg(raw, '' ORDER BY pos) FILTER (level IS NULL), '')")})::BIGINT AS n_chars FROM s WHERE seq > 0 GROUP BY extraction_id, seq""")
def q_section_spans(spark, d):
    return structure.sections(_cut(spark, d), "extraction_id").select("extraction_id", "seq", "level", "title", F.length("html").cast("bigint").alias("n_chars"))


_plain = rr("content", r"[#*`>\-|\[\]()]")


@query(f"SELECT section_key, len({words_(trim_(_plain))})::BIGINT AS word_count, length({trim_(_plain)})::BIGINT AS char_count FROM {SECTIONS}")
def q_section_meta(spark, d):
    rows = sections(spark, d).select("section_key", X.section_measures(F.col("content")).alias("m"))
    return rows.select("section_key", F.col("m.word_count").cast("bigint").alias("word_count"), F.col("m.char_count").cast("bigint").alias("char_count"))


_md = rr("content", r"(?m)^#{1,6}\s+")
for _p, _t in ((r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"`([^`]+)`", r"\1"), (r"```\n?", ""), (r"(?m)^\s*[-*+]\s+", "  "), (r"(?m)^\s*\d+\.\s+", "  "), (r"(?m)^>\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1")):
    _md = rr(_md, _p, _t)
_md = f"array_to_string(list_transform(string_split({_md}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '\\|[^\\n]+\\|') THEN replace(x, '|', ' ') ELSE x END), chr(10))"
_md = trim_(rr(rr(rr(_md, r"(?m)^[\s|:\-]+$"), "---"), r"\n{3,}", "\n\n"))


@query(f"SELECT section_key, {rr(_md, WS_ + '+', ' ')} AS text FROM {SECTIONS}")
def q_strip_markdown(spark, d):
    return sections(spark, d).select("section_key", F.regexp_replace(X.strip_markdown(F.col("content")), f"{X.WS}+", " ").alias("text"))


@query(f"SELECT doc_id, nullif({trim_(chr(114) + 'egexp_extract(html, ' + q('(?i)(?:by|por|author:' + chr(92) + 's*)([^<]{2,50})') + ', 1)')}, '') AS author FROM {HTML}")
def q_author_sniff(spark, d):
    return text_html(spark, d).select("doc_id", X.author_of(F.col("html")).alias("author"))


@query(f"SELECT DISTINCT title, lower({rr(trim_(rr('coalesce(nullif(title, ' + q('') + '), ' + q('document') + ')', '[^a-zA-Z0-9_ -]')), chr(92) + 's+', '-')}) AS slug FROM document_metadata")
def q_slug(spark, d):
    return read_table(spark, d, "document_metadata").select("title", X.slug(F.col("title")).alias("slug")).distinct()


@query(f"""SELECT extraction_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1),
  lambda p: {trim_(rr("replace(replace(replace(replace(replace(" + rr('p', '<[^>]+>') + ", '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160))", chr(92) + "s*" + chr(92) + "n" + chr(92) + "s*", " "))}), lambda p: p <> ''), chr(10) || chr(10)) AS markdown FROM {PAGES}""")
def q_paragraph_markdown(spark, d):
    return pages(spark, d).select("extraction_id", structure.paragraph_markdown(F.col("html")).alias("markdown"))


@query()
def q_html_to_markdown(spark, d):
    return spread(pages(spark, d)).select("extraction_id", A.html_to_markdown("html").alias("markdown"))


@query()
def q_html_to_standard(spark, d):
    return spread(pages(spark, d)).select("extraction_id", A.html_to_standard("html").alias("html"))


# ---- chunks ----------------------------------------------------------------------------------------

_tokens_sql = "len(regexp_extract_all({v}, '\\p{{L}}+|\\p{{N}}{{1,3}}|[^\\s\\p{{L}}\\p{{N}}]'))"


@query(f"SELECT doc_id, {_tokens_sql.format(v='text')}::BIGINT AS tokens FROM documents")
def q_token_counts(spark, d):
    return documents(spark, d).select("doc_id", X.count_pattern_tokens(F.col("text")).cast("bigint").alias("tokens"))


@query()
def q_sentences(spark, d):
    return documents(spark, d).select("doc_id", A.n_sentences("text").alias("n_sentences"))


_fit_sql = f"SELECT doc_id, section_key, row_number() OVER (PARTITION BY doc_id ORDER BY seq, section_key) - 1 AS index, content FROM {SECTIONS} WHERE {_tokens_sql.format(v='content')} <= 1000 AND {trim_('content')} <> ''"


@query(f"SELECT doc_id, section_key, index, printf('chunk-%03d', index + 1) AS chunk_id, count(*) OVER (PARTITION BY doc_id) AS total FROM ({_fit_sql})")
def q_chunks_fit(spark, d):
    rows = sections(spark, d).filter((X.count_pattern_tokens(F.col("content")) <= 1000) & (X.trim(F.col("content")) != ""))
    w = W.partitionBy("doc_id").orderBy("seq", "section_key")
    rows = rows.select("doc_id", "section_key", (F.row_number().over(w) - 1).alias("index"))
    return chunking.numbered(rows, "doc_id")


def _section_blocks(spark, d) -> DataFrame:
    rows = sections(spark, d)
    return rows.select("doc_id", "seq", "content", "chapter", "section")


@query()
def q_chunks_full(spark, d):
    options = chunking.ChunkOptions(min_tokens=60, max_tokens=120, target_tokens=90)
    return chunking.chunks(_section_blocks(spark, d), "doc_id", options)


@query(f"""WITH s AS (SELECT doc_id, seq, {trim_('content')} AS body, chapter, section, content FROM {SECTIONS} WHERE {trim_('content')} <> ''),
  o AS (SELECT *, row_number() OVER w AS pos, lag(body) OVER w AS before FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seq, content, chapter NULLS FIRST, section NULLS FIRST)),
  x AS (SELECT *, string_split_regex(before, {q(r'[' + chr(92) + 's' + chr(92) + 'x{1c}-' + chr(92) + 'x{1f}' + chr(92) + 'x{85}' + chr(92) + 'x{a0}' + chr(92) + 'x{1680}' + chr(92) + 'x{2000}-' + chr(92) + 'x{200a}' + chr(92) + 'x{2028}' + chr(92) + 'x{2029}' + chr(92) + 'x{202f}' + chr(92) + 'x{205f}' + chr(92) + 'x{3000}]+')}) AS w FROM o)
  SELECT doc_id, pos - 1 AS index, CASE WHEN before IS NULL THEN '' ELSE array_to_string(w[len(w) - least(ceil(len(w) / 10.0), 50)::INT + 1:], ' ') || chr(10) || chr(10) END || body AS content, chapter, section,
  printf('chunk-%03d', pos) AS chunk_id, count(*) OVER (PARTITION BY doc_id) AS total FROM x""")
def q_chunks_whole_sections(spark, d):
    """Chunks of bounds that every section fits: each section begins with the words that the one before leaves."""
    options = chunking.ChunkOptions(max_tokens=1 << 30, target_tokens=1 << 30, overlap="fixed")
    return chunking.chunks(_section_blocks(spark, d), "doc_id", options).drop("token_count", "overlap_tokens")


@query()
def q_chunks_fixed_overlap(spark, d):
    options = chunking.ChunkOptions(min_tokens=60, max_tokens=120, target_tokens=90, overlap="fixed", preserve_structures=False)
    return chunking.chunks(_section_blocks(spark, d), "doc_id", options)


_ws = "string_split_regex(text, " + q(WS_ + "+") + ")"


@query(f"SELECT doc_id, array_to_string(w[len(w) - n + 1:], ' ') AS overlap FROM (SELECT doc_id, w, least(ceil(len(w) * 0.1), 50)::INT AS n FROM (SELECT doc_id, {_ws} AS w FROM documents))")
def q_fixed_overlap(spark, d):
    return documents(spark, d).select("doc_id", X.last_words(F.col("text")).alias("overlap"))


@query(f"""WITH l AS (SELECT doc_id, b[1] AS pos, regexp_matches({trim_('b[2]')}, '^(?:[-*+]|\\d+\\.)\\s') AS item FROM (SELECT doc_id, unnest(list_zip(range(len(x)), x)) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
  n AS (SELECT *, CASE WHEN item AND NOT coalesce(lag(item) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 1 ELSE 0 END AS first FROM l),
  r AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS run_no FROM n)
  SELECT doc_id, run_no, count(*) AS n_lines FROM r WHERE item GROUP BY doc_id, run_no""")
def q_list_runs(spark, d):
    return chunking.list_runs(documents(spark, d), "doc_id", "text")


@query(f"SELECT chunk_key, doc_id, substr(content, 1, 200) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position_index, chunk_key) AS r FROM {CHUNKS}) WHERE r <= 5")
def q_chunk_preview(spark, d):
    w = W.partitionBy("doc_id").orderBy("position_index", "chunk_key")
    return chunk_rows(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("chunk_key", "doc_id", F.substring("content", 1, 200).alias("preview"))


# ---- scores ----------------------------------------------------------------------------------------


@query(f"SELECT extraction_id, floor(avg({_sure_sql}) * 100 + 0.5)::BIGINT AS structure_preserved FROM ({_heading_sql}) GROUP BY extraction_id")
def q_quality_structure(spark, d):
    return structure.indicators(structure.headings(_cut(spark, d), "extraction_id"), "extraction_id")


_filled = lambda c: f"CASE WHEN {c} IS NOT NULL AND {c} <> '' THEN 1 ELSE 0 END"
_complete = f"floor(({_filled('title')} + {_filled('author')} + {_filled('language')} + CASE WHEN source_format IS NOT NULL AND source_format NOT IN ('', 'unknown') THEN 1 ELSE 0 END) / 4.0 * 100 + 0.5)"


@query(f"SELECT doc_id, {_complete}::BIGINT AS metadata_completeness FROM {NEWEST}")
def q_quality_indicators(spark, d):
    m = metadata(spark, d)
    return m.select("doc_id", quality.completeness(*[F.col(c) for c in ("title", "author", "language", "source_format")]).cast("bigint").alias("metadata_completeness"))


_size = "coalesce(token_count, 0) - coalesce(overlap_tokens, 0)"
_consistency_sql = f"""SELECT doc_id, count(*) AS n_chunks, greatest(0, least(100, floor(avg(CASE WHEN {_size} BETWEEN 60 AND 400 THEN 1.0 ELSE 0.0 END) * 100 - least(CASE WHEN avg({_size}) > 0 THEN stddev_pop({_size}) / avg({_size}) ELSE 0 END * 50, 30) + 0.5)))::BIGINT AS consistency,
  avg({_filled('chapter_title')}::DOUBLE) AS with_chapter, avg({_filled('section_title')}::DOUBLE) AS with_section FROM {CHUNKS} GROUP BY doc_id"""
_depths_sql = f"SELECT doc_id, max(level) AS depth FROM {SECTIONS} GROUP BY doc_id"
_base = f"floor(({_filled('title')} + {_filled('author')} + {_filled('language')} + CASE WHEN n_chunks > 0 THEN CASE WHEN with_chapter > 0.5 THEN 1 ELSE 0 END + CASE WHEN with_section > 0.3 THEN 1 ELSE 0 END WHEN {_complete} > 50 THEN 1 ELSE 0 END) / 5.0 * 100 + 0.5)"


@query(f"""SELECT doc_id, structure, chunk_consistency, metadata, floor(structure * 0.4 + coalesce(chunk_consistency, 50) * 0.3 + metadata * 0.3 + 0.5)::BIGINT AS overall FROM (
  SELECT m.doc_id, least(floor(CASE WHEN coalesce(is_scanned, false) THEN 100 * 0.6 ELSE 100 END * 0.8 + least(coalesce(depth, 1) * 10, 20) + 0.5), 100)::BIGINT AS structure, consistency AS chunk_consistency,
  CASE WHEN ocr_confidence > 80 THEN least(100, {_base} + 5) WHEN ocr_confidence < 60 THEN greatest(0, {_base} - 10) ELSE {_base} END::BIGINT AS metadata
  FROM {NEWEST} m LEFT JOIN ({_consistency_sql}) c USING (doc_id) LEFT JOIN ({_depths_sql}) s USING (doc_id))""")
def q_quality_scores(spark, d):
    rows = chunk_rows(spark, d).withColumnsRenamed({"chapter_title": "chapter", "section_title": "section"})
    measures = quality.chunk_measures(rows, "doc_id", least=60, most=400)
    depth = sections(spark, d).groupBy("doc_id").agg(F.max("level").alias("depth"))
    m = metadata(spark, d).join(measures, "doc_id", "left").join(depth, "doc_id", "left")
    c = {n: F.col(n) for n in ("title", "author", "language", "source_format", "n_chunks", "with_chapter", "with_section", "ocr_confidence", "is_scanned", "depth", "consistency")}
    whole = quality.completeness(c["title"], c["author"], c["language"], c["source_format"])
    m = m.select(
        "doc_id",
        quality.structure_score(F.lit(100.0), c["is_scanned"], c["depth"]).cast("bigint").alias("structure"),
        F.col("consistency").alias("chunk_consistency"),
        quality.metadata_score(c["title"], c["author"], c["language"], c["n_chunks"], c["with_chapter"], c["with_section"], whole, c["ocr_confidence"]).cast("bigint").alias("metadata"),
    )
    return m.withColumn("overall", quality.overall(F.col("structure"), F.col("chunk_consistency"), F.col("metadata")).cast("bigint"))


# ---- exports ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, count(*) AS total_chunks, sum(coalesce(token_count, 0))::BIGINT AS total_tokens, floor(avg(coalesce(token_count, 0)) + 0.5)::BIGINT AS avg_chunk_size FROM {CHUNKS} GROUP BY doc_id")
def q_export_stats(spark, d):
    return export.stats(chunk_rows(spark, d), "doc_id")


_share = "coalesce(printf('%.1f', ocr_confidence), 'N/A')"
_head_sql = f"""CASE WHEN title IS NOT NULL AND title <> '' THEN '# ' || title || {NL} || {NL} ELSE '' END || '---' || {NL}
  || CASE WHEN author IS NOT NULL AND author <> '' THEN 'author: ' || author || {NL} ELSE '' END || CASE WHEN language IS NOT NULL AND language <> '' THEN 'language: ' || language || {NL} ELSE '' END
  || CASE WHEN source_format IS NOT NULL AND source_format <> '' THEN 'source: ' || source_format || {NL} ELSE '' END
  || CASE WHEN coalesce(is_scanned, false) THEN 'ocr_engine: ' || coalesce(ocr_engine, 'unknown') || {NL} || 'ocr_confidence: ' || {_share} || '%' || {NL} ELSE '' END || '---' || {NL} || {NL}
  || CASE WHEN coalesce(is_scanned, false) THEN '> *Extracted via OCR (' || coalesce(ocr_engine, 'unknown') || ', confidence: ' || {_share} || '%)*' || {NL} || {NL} ELSE '' END"""


@query(f"""SELECT doc_id, {_head_sql} || coalesce(body, '') AS markdown FROM {NEWEST} LEFT JOIN (SELECT doc_id, string_agg({trim_('content')} || {NL} || {NL}, '' ORDER BY seq, {trim_('content')}) AS body FROM {SECTIONS} WHERE {trim_('content')} <> '' GROUP BY doc_id) USING (doc_id)""")
def q_export_md(spark, d):
    m = metadata(spark, d)
    head = export.markdown_head({c: F.col(c) for c in m.columns})
    body = export.section_markdown(sections(spark, d), "doc_id")
    return m.join(body, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


@query(f"""SELECT doc_id, {rr("string_agg(CASE WHEN title IS NOT NULL AND title NOT IN ('', 'Document') THEN title || chr(10) || chr(10) ELSE '' END || " + _md + " || chr(10) || chr(10), '' ORDER BY seq, section_key)", WS_ + '+', ' ')} AS body FROM {SECTIONS} GROUP BY doc_id""")
def q_export_txt(spark, d):
    body = export.section_text(sections(spark, d).withColumn("seq", F.struct("seq", "section_key")), "doc_id")
    return body.select("doc_id", F.concat(F.regexp_replace("body", f"{X.WS}+$", ""), F.lit(" ")).alias("body")).select("doc_id", F.regexp_replace("body", f"{X.WS}+", " ").alias("body"))


_json_field = lambda name, v: f"CASE WHEN {v} IS NULL THEN '' ELSE ',\"{name}\":' || to_json({v})::VARCHAR END"


@query(f"""SELECT chunk_key, '{{' || substr({_json_field('text', 'content')} || {_json_field('chunk_id', 'chunk_id')} || {_json_field('token_count', 'token_count')}
  || ',"metadata":{{' || substr({_json_field('title', 'm.title')} || {_json_field('chapter', 'chapter_title')} || {_json_field('section', 'section_title')}
  || ',"position":{{' || substr({_json_field('index', 'position_index')} || {_json_field('total', 'position_total')}, 2) || '}}', 2) || '}}'
  || {_json_field('ocr_confidence', 'CASE WHEN m.is_scanned THEN m.ocr_confidence END')}, 2) || '}}' AS line FROM {CHUNKS} c LEFT JOIN {NEWEST} m USING (doc_id)""")
def q_export_jsonl(spark, d):
    rows = chunk_rows(spark, d).withColumnsRenamed({"chapter_title": "chapter", "section_title": "section", "position_index": "index", "position_total": "total"})
    m = metadata(spark, d).select("doc_id", "title", "is_scanned", "ocr_confidence")
    sure = F.when(F.col("is_scanned"), F.col("ocr_confidence"))
    return rows.join(m, "doc_id", "left").select("chunk_key", export.jsonl_record(F.col("title"), True, sure).alias("line"))


@query("SELECT doc_id, parent_seq, count(*) AS children FROM (SELECT DISTINCT doc_id, seq, parent_seq FROM sections) WHERE parent_seq IS NOT NULL GROUP BY doc_id, parent_seq")
def q_child_counts(spark, d):
    rows = read_table(spark, d, "sections").select("doc_id", "seq", "parent_seq").distinct()
    return rows.filter("parent_seq is not null").groupBy("doc_id", "parent_seq").agg(F.count("*").alias("children"))


# ---- recognised pages ------------------------------------------------------------------------------


@query("""SELECT doc_id, count(*) AS page_count, round(avg(confidence), 6) AS ocr_confidence, coalesce(array_to_string(list_sort(list(DISTINCT page_number) FILTER (confidence < 60)), ','), '') AS low_pages
  FROM (SELECT DISTINCT doc_id, page_number, text, confidence FROM ocr_pages) GROUP BY doc_id""")
def q_ocr_assemble(spark, d):
    rows = assemble_pages(read_table(spark, d, "ocr_pages"))
    return rows.select("doc_id", "page_count", F.round("ocr_confidence", 6).alias("ocr_confidence"), F.array_join(F.transform("low_confidence_pages", lambda x: x.cast("string")), ",").alias("low_pages"))


_garbage = "length(t) >= 3 AND ((len(regexp_extract_all(t, '[=|{}\\[\\]<>_~^\\\\]')) > length(t) * 0.3 AND len(regexp_extract_all(t, '(?i)[a-záàâãéèêíïóôõúüç]'))::DOUBLE / length(t) < 0.4) OR (length(t) < 20 AND len(regexp_extract_all(t, '[=|{}\\[\\]<>_~^\\\\]')) > 3))"


@query(f"SELECT doc_id, count(*) AS n_dropped FROM (SELECT doc_id, {trim_('x')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)) WHERE {_garbage} GROUP BY doc_id")
def q_ocr_garbage_lines(spark, d):
    lines = documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return lines.filter(X.garbage_line(F.col("x"))).groupBy("doc_id").agg(F.count("*").alias("n_dropped"))


@query()
def q_ocr_fix(spark, d):
    rows = spread(read_table(spark, d, "ocr_pages").select("page_key", "text").distinct()).select("page_key", A.fix_ocr("text").alias("f"))
    return rows.select("page_key", "f.*")


# ---- caches ----------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def q_content_hash(spark, d):
    return documents(spark, d).select("doc_id", cache.key_of(F.col("text")).alias("sha256"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS cache_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY sha256(text)")
def q_cache_miss(spark, d):
    rows = read_table(spark, d, "documents").select("doc_id", "lang", cache.key_of(F.col("text")).alias("cache_key"))
    missed = cache.misses(rows.groupBy("cache_key").agg(F.min("doc_id").alias("doc_id")), rows.filter("lang = 'en'").select("cache_key"))
    return missed.select("doc_id", "cache_key")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'failed' ELSE 'ok' END AS status FROM documents) GROUP BY status")
def q_batch_status(spark, d):
    status = F.when(F.col("text").isNull() | (F.trim("text") == ""), "failed").otherwise("ok")
    return documents(spark, d).select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))
