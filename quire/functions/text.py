"""Text and HTML steps as Catalyst expressions: extraction of plain text, normalising, cleaning, measures.

Every function takes and returns a ``Column``; null in, null out.  Empty text stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.constants import ALLOWED_TAGS, LEAST_LEAD, LEAST_SHARE, LEAST_WORDS, STOPWORDS

WS = r"[\s\x{A0}\x{FEFF}\x{2028}\x{2029}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{1680}]"  # white space in the wide sense


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rounded(c: Column) -> Column:
    """Halves upwards."""
    return F.floor(c + 0.5)


# ---- plain text to HTML ----------------------------------------------------------------------------


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def paragraphs(c: Column) -> Column:
    """The paragraphs of plain text: cut at blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, rf"\n{WS}*\n"), trim), lambda p: p != "")


def text_to_html(c: Column) -> Column:
    body = F.array_join(F.transform(paragraphs(c), lambda p: F.concat(F.lit("<p>"), escape(p), F.lit("</p>"))), "\n")
    return F.concat(F.lit("<article>\n"), body, F.lit("\n</article>"))


# ---- the HTML dialect ------------------------------------------------------------------------------


def tags(c: Column) -> Column:
    """Distinct names of the tags in HTML, in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"</?([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>"), 1), F.lower)))


def invalid_tags(c: Column) -> Column:
    allowed = F.array(*[F.lit(t) for t in ALLOWED_TAGS])
    return F.array_except(tags(c), allowed)


def strip_disallowed(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)</?(?!(?:{'|'.join(ALLOWED_TAGS)})\b)[a-zA-Z][a-zA-Z0-9]*\b[^>]*>", "")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


# ---- normalising -----------------------------------------------------------------------------------


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, r"^\x{FEFF}", "")


def typography(c: Column) -> Column:
    quotes = F.translate(c, "‘’‚‛“”„‟–— ", "''''\"\"\"\"-- ")
    return F.replace(quotes, F.lit("…"), F.lit("..."))


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(\p{L})-\s*\n\s*(\p{L})", "$1$2")


def unwrap(c: Column) -> Column:
    """Joins lines inside paragraphs; other text keeps its lines."""
    parts = F.split(c, r"(?i)(?=<p[^>]*>)|(?<=</p>)")
    joined = F.transform(parts, lambda x: F.when(x.rlike(r"(?i)^<p[^>]*>"), F.regexp_replace(x, r"([\p{L},;.!?:)])\s*\n\s*([\p{L}(])", "$1 $2")).otherwise(x))
    return F.array_join(joined, "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)(<pre[^>]*>.*?</pre>)|(<code[^>]*>.*?</code>)|( ) +", "$1$2$3")


def trim_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?m) +$", ""), r" +(</(?!pre|code)[a-zA-Z]+>)", "$1")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def normalize(c: Column, nfc=None) -> Column:
    """All normalising steps in order; ``nfc`` is the Arrow function for Unicode composition."""
    c = strip_bom(c)
    c = nfc(c) if nfc is not None else c
    return strip_controls(trim_lines(collapse_spaces(unwrap(dehyphenate(typography(c))))))


# ---- cleaning --------------------------------------------------------------------------------------

#: Patterns of what cleaning removes (fixed values).
PAGE_NUMBERS = (r"(?i)<p[^>]*>\s*-?\s*\d{1,4}\s*-?\s*</p>", r"(?i)<p[^>]*>\s*(?:page|p\.?|pg\.?)\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*</p>")
ISBN = r"ISBN[-\s]?(?:13|10)?[\s:]*(?:\d[-\s]?){9,13}[\dXx]"
LEGAL = tuple(rf"(?i)<p[^>]*>[^<]*{x}[^<]*</p>" for x in (r"(?:copyright|©|\(c\))", r"all\s+rights\s+reserved", r"published\s+by", r"printed\s+in"))
DECORATIVE = r"(?i)<p[^>]*>\s*[*=\-_~#]{3,}\s*</p>"
#: A paragraph whose text, trimmed, has a digit and at most four characters goes, but not a capital with three more.
ORPHAN = r"(?i:<p[^>]*>)\s*(?=[^<]*[0-9])(?![A-Z][^<]{2}[^<\s]\s*(?i:</p>))(?:[^<\s][^<]{0,2}[^<\s]|[^<\s])\s*(?i:</p>)"
EMPTY = r"(?i)<(p|section|div)[^>]*>\s*</\1>"
LEVELS = {"light": 0, "standard": 1, "aggressive": 2}


def page_numbers(c: Column) -> Column:
    for p in PAGE_NUMBERS:
        c = F.regexp_replace(c, p, "")
    return c


def blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def isbn(c: Column) -> Column:
    return F.regexp_replace(c, ISBN, "")


def legal(c: Column) -> Column:
    for p in LEGAL:
        c = F.regexp_replace(c, p, "")
    return c


def decorative(c: Column) -> Column:
    return F.regexp_replace(c, DECORATIVE, "")


def orphans(c: Column) -> Column:
    """Removes tag-free paragraphs of one to four characters with a digit, unless four begin with a capital."""
    return F.regexp_replace(c, ORPHAN, "")


def empty_tags(c: Column) -> Column:
    return F.regexp_replace(c, EMPTY, "")


def without_patterns(c: Column, patterns: Column) -> Column:
    """Deletes every literal occurrence of each text of an array."""
    return F.aggregate(patterns, c, lambda text, p: F.replace(text, p, F.lit("")))


def clean(c: Column, level: str = "standard", patterns: Column | None = None) -> Column:
    """All cleaning steps of a level in order; ``patterns`` are the repeated texts to delete."""
    depth = LEVELS[level]
    c = blank_lines(page_numbers(c))
    if depth >= 1:
        if patterns is not None:
            c = without_patterns(c, patterns)
        c = legal(isbn(c))
    if depth >= 2:
        c = decorative(orphans(c))
    return empty_tags(c)


def audit(c: Column, level: str = "standard", patterns: Column | None = None) -> Column:
    """What ``clean`` removes with the same arguments, in order: array of (type, removed)."""
    depth, parts = LEVELS[level], []

    def removed(kind: str, text: Column, pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), 0)
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("type"), trim(without_tags(x)).alias("removed")))

    text = c
    for p in PAGE_NUMBERS:
        parts.append(removed("page_number", text, p))
        text = F.regexp_replace(text, p, "")
    new = blank_lines(text)
    one = F.array(F.struct(F.lit("whitespace").alias("type"), F.lit("(excessive blank lines)").alias("removed")))
    parts.append(F.when(new != text, one).otherwise(F.slice(one, 1, 0)))
    text = new
    if depth >= 1:
        if patterns is not None:
            counted = repeated(text, patterns)
            entries = F.transform(counted["found"], lambda x: F.array_repeat(F.struct(F.lit("repeated_pattern").alias("type"), x["text"].alias("removed")), x["n"]))
            parts.append(F.flatten(entries))
            text = counted["rest"]
        parts.append(removed("isbn", text, ISBN))
        text = isbn(text)
        for p in LEGAL:
            parts.append(removed("legal_credit", text, p))
            text = F.regexp_replace(text, p, "")
    if depth >= 2:
        parts.append(removed("orphan_paragraph", text, ORPHAN))
        parts.append(removed("decorative", orphans(text), DECORATIVE))
    return F.concat(*parts)


def repeated(c: Column, patterns: Column) -> Column:
    """Struct of the text without the literal patterns, and how often each was deleted in turn (those of no text never)."""
    none = F.array().cast("array<struct<text:string,n:int>>")

    def step(state: Column, p: Column) -> Column:
        rest = F.replace(state["rest"], p, F.lit(""))
        n = F.when(F.length(p) > 0, (F.length(state["rest"]) - F.length(rest)) / F.length(p)).otherwise(0).cast("int")
        return F.struct(rest.alias("rest"), F.concat(state["found"], F.array(F.struct(p.alias("text"), n.alias("n")))).alias("found"))

    return F.aggregate(patterns, F.struct(c.alias("rest"), none.alias("found")), step)


# ---- measures --------------------------------------------------------------------------------------


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{WS}+"), lambda w: w != "")


def _hits(found: Column, known: list[str]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(*known)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def language_scores(c: Column) -> Column:
    """Struct of en, pt, es (shares of frequent words), language and confidence, from text with or without tags."""
    codes = list(STOPWORDS)

    def shares(found: Column) -> Column:
        n = F.size(found)
        return F.struct((n < LEAST_WORDS).alias("few"), *[F.when(n < LEAST_WORDS, 0.0).otherwise(_hits(found, STOPWORDS[k]) / n).alias(k) for k in codes])

    def judged(s: Column) -> Column:
        ranked = F.sort_array(F.array(*[F.struct(s[k].alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("code")) for i, k in enumerate(codes)]), asc=False)
        return let(ranked, lambda r: F.struct(*[s[k].alias(k) for k in codes], F.when(s["few"] | (r[0]["score"] < LEAST_SHARE) | (r[0]["score"] - r[1]["score"] < LEAST_LEAD), "unknown").otherwise(r[0]["code"]).alias("language"), r[0]["score"].alias("confidence")))

    return F.when(c.isNotNull(), let(words(F.lower(without_tags(c))), lambda found: let(shares(found), judged)))


def section_measures(c: Column) -> Column:
    """Words and characters of Markdown without its marks."""
    plain = trim(F.regexp_replace(c, r"[#*`>\-|\[\]()]", ""))
    return F.struct(F.size(words(plain)).alias("word_count"), F.length(plain).alias("char_count"))


def author_of(c: Column) -> Column:
    """The first credit line's name, or null."""
    found = F.regexp_extract(c, r"(?i)(?:by|por|author:\s*)([^<]{2,50})", 1)
    return F.nullif(trim(found), F.lit(""))


def slug(title: Column) -> Column:
    """A file name of a title: letters, digits, - and _ in lower case, spaces as -."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("document"))
    return F.lower(F.regexp_replace(trim(F.regexp_replace(named, r"[^a-zA-Z0-9\-_ ]", "")), r"\s+", "-"))


def last_words(c: Column) -> Column:
    """The last tenth of the words, at most fifty, for a fixed overlap."""
    found = F.split(c, rf"{WS}+")
    n = F.least(F.ceil(F.size(found) * 0.1), F.lit(50)).cast("int")
    return F.array_join(F.slice(found, F.greatest(F.size(found) - n + 1, F.lit(1)), F.greatest(n, F.lit(0))), " ")


def count_pattern_tokens(c: Column) -> Column:
    """Tokens by a plain pattern: words, numbers of up to three digits, single signs."""
    return F.regexp_count(c, F.lit(r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]"))


def strip_markdown(c: Column) -> Column:
    """Plain text of Markdown; inline code goes before fences, so a fence leaves stray marks behind."""
    steps = (
        (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"```\n?", ""),
        (r"(?m)^\s*[-*+]\s+", "  "), (r"(?m)^\s*\d+\.\s+", "  "), (r"(?m)^>\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    )
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    rows = F.transform(F.split(c, "\n"), lambda x: F.when(x.rlike(r"\|[^\n]+\|"), F.translate(x, "|", " ")).otherwise(x))
    c = F.array_join(rows, "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^[\s|:\-]+$", ""), "---", "")
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def garbage_line(line: Column) -> Column:
    """Whether a line is recognition debris: mostly signs, few letters."""
    t = trim(line)
    signs, letters, n = F.regexp_count(t, F.lit(r"[=|{}\[\]<>_~^\\]")), F.regexp_count(t, F.lit("(?i)[a-záàâãéèêíïóôõúüç]")), F.length(t)
    return (n >= 3) & (((signs > n * 0.3) & (letters / n < 0.4)) | ((n < 20) & (signs > 3)))


def without_garbage(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~garbage_line(x)), "\n")
