"""Headings, sections and the section tree, from blocks of HTML.

``blocks`` is the one place where HTML is cut; what follows are projections, unions and
windows that share the partitioning by document, so the whole stage costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.constants import CONFIDENCE, TITLE_WORDS

BLOCK = r"(?i)(?=<h[1-6][^>]*>)|(?<=</h[1-6]>)|(?=<p[^>]*>)|(?<=</p>)"
PREFIXES = ("ch", "s", "ss", "p", "sp", "ssp")


def blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, level, text, raw): the pieces of HTML in order; kind is h, p or other.

    Null or empty HTML has no blocks; rows with equal keys are one document, so give distinct keys.
    """
    cut = df.select(F.col(key), F.posexplode(F.split(F.col(html), BLOCK)).alias("pos", "raw")).filter("raw != ''")
    tag = F.regexp_extract("raw", r"(?i)^<h([1-6])[^>]*>[^\n]*</h\1>$", 1)
    inner = F.regexp_extract("raw", r"(?i)^<(?:h[1-6]|p)[^>]*>([^\n]*)</(?:h[1-6]|p)>$", 1)
    kind = F.when(tag != "", "h").when(F.col("raw").rlike(r"(?i)^<p[^>]*>[^\n]*</p>$"), "p").otherwise("other")
    return cut.select(key, "pos", kind.alias("kind"), F.when(tag != "", tag.cast("int")).alias("level"), X.trim(X.without_tags(inner)).alias("text"), "raw")


def numbered_level(t: Column) -> Column:
    """The level that a numbering gives: dots of 1.2.3., Roman numerals, single letters; null without one."""
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\.\s", 1)
    return (
        F.when(number != "", F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(6)))
        .when(t.rlike(r"(?i)^[IVXLCDM]+\.\s"), 1)
        .when(t.rlike(r"^[a-zA-Z][.)]\s"), 3)
    )


def titled_level(t: Column) -> Column:
    """The level that an opening word gives (part, chapter, section, appendix); null without one."""
    out = F.lit(None).cast("int")
    for pattern, level in reversed(TITLE_WORDS):
        out = F.when(t.rlike("(?iu)" + pattern), level).otherwise(out)
    return out


def shouted(t: Column) -> Column:
    """Whether a short text is all in capitals."""
    return (F.length(t) < 100) & (F.upper(t) == t) & t.rlike("[A-Z]")


def headings(cut: DataFrame, key: str) -> DataFrame:
    """(key, pos, ordinal, level, text, source, confidence): at most one for each block, the surest.

    Of sources of equal confidence the first tried holds (none tie here).  Paragraphs over 200 characters are none.
    """
    t = F.col("text")
    short = (F.col("kind") == "p") & (t != "") & (F.length(t) <= 200)
    by_title, by_number = titled_level(t), numbered_level(t)
    level = F.when(F.col("kind") == "h", F.col("level")).when(short, F.coalesce(by_title, by_number, F.when(shouted(t), 2)))
    source = F.when(F.col("kind") == "h", "html-tag").when(by_title.isNotNull(), "linguistic").when(by_number.isNotNull(), "numbering").otherwise("uppercase")
    found = cut.filter(t != "").select(key, "pos", level.alias("level"), "text", source.alias("source")).filter("level is not null")
    sure = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    order = W.partitionBy(key).orderBy("pos")
    return found.select(key, "pos", F.row_number().over(order).alias("ordinal"), "level", "text", "source", sure[F.col("source")].alias("confidence"))


def section_tree(found: DataFrame, key: str, order: str = "ordinal") -> DataFrame:
    """Adds seq, id, parent_seq, depth, chapter and section to rows of (key, order, level, text).

    A section's parent is the last one before it of a lower level; its id counts, for each level up to its own,
    the sections since the last one of a lower level (levels without any are left out).
    """
    w = W.partitionBy(key).orderBy(order)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = found.withColumn("seq", F.row_number().over(w))
    for k in range(1, 7):
        lower = F.sum((F.col("level") < k).cast("int")).over(w)
        rows = rows.withColumn(f"_g{k}", F.coalesce(lower, F.lit(0)))
        rows = rows.withColumn(f"_p{k}", F.last(F.when(F.col("level") == k, F.col("seq")), True).over(before))
    for k in range(1, 7):
        rows = rows.withColumn(f"_n{k}", F.sum((F.col("level") == k).cast("int")).over(W.partitionBy(key, f"_g{k}").orderBy(order)))
    named = F.concat_ws("-", *[F.when((F.col("level") >= k) & (F.col(f"_n{k}") > 0), F.concat(F.lit(PREFIXES[k - 1]), F.col(f"_n{k}"))) for k in range(1, 7)])
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_p{k}")) for k in range(1, 6)], F.lit(None).cast("int"))
    # a level's last section is an ancestor if nothing of a lower or equal level came after it
    live = [F.when((F.col("level") > k) & F.col(f"_p{k}").isNotNull() & (F.greatest(F.lit(-1), F.lit(-2), *[F.coalesce(F.col(f"_p{j}"), F.lit(-1)) for j in range(1, k)]) < F.col(f"_p{k}")), 1).otherwise(0) for k in range(1, 6)]
    depth = sum(live[1:], live[0]) + 1
    top = F.last(F.when(F.col("level") == 1, F.col("text")), True).over(w)
    rows = rows.withColumn("id", named).withColumn("parent_seq", parent).withColumn("depth", depth)
    rows = rows.withColumn("chapter", F.coalesce(top, F.col("text"))).withColumn("section", F.when(F.col("level") == 2, F.col("text")))
    return rows.drop(*[f"_{x}{k}" for x in "gpn" for k in range(1, 7)])


def sections(cut: DataFrame, key: str, keep_preamble: bool = False) -> DataFrame:
    """(key, seq, level, title, html): documents cut at their headings; text before the first goes unless kept.

    A document without headings is one section of level 1 named Document.
    """
    found = headings(cut, key).select(key, "pos", F.col("level").alias("_level"), F.col("text").alias("_title"))
    w = W.partitionBy(key).orderBy("pos")
    rows = cut.select(key, "pos", "raw").join(found, [key, "pos"], "left").withColumn("seq", F.count("_level").over(w))
    grouped = rows.groupBy(key, "seq").agg(
        F.max("_level").alias("level"),
        F.max("_title").alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_level").isNull(), F.struct("pos", "raw")))), lambda x: x["raw"]), "").alias("html"),
    )
    last = F.max("seq").over(W.partitionBy(key))
    grouped = grouped.withColumn("_last", last)
    flat = F.col("_last") == 0
    kept = grouped.filter((F.col("seq") > 0) | flat | F.lit(keep_preamble))
    return kept.select(key, F.when(flat, 1).otherwise(F.col("seq")).alias("seq"), F.when(F.col("level").isNull(), 1).otherwise(F.col("level")).alias("level"), F.coalesce("title", F.lit("Document")).alias("title"), X.trim(F.col("html")).alias("html"))


def paragraph_markdown(html: Column) -> Column:
    """Markdown of HTML that has only paragraphs, breaks and rules (general HTML goes to ``html_to_markdown``)."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1)
    shown = F.transform(found, lambda p: X.trim(F.regexp_replace(unescape(X.without_tags(p)), r"\s*\n\s*", " ")))
    return F.array_join(F.filter(shown, lambda p: p != ""), "\n\n")


def unescape(c: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def repeated_blocks(df: DataFrame, key: str, html: str, least: int = 3) -> DataFrame:
    """(key, text, n, confidence, positions): texts of blocks that come back at least ``least`` times in a document.

    Blocks are one-line p, div and span of 1 to 199 characters; case does not count; the first spelling is kept.
    Counting is by (document, text), so one document's blocks are spread over tasks.
    """
    inner = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<(?:p|div|span)[^>]*>([^\n]*?)</(?:p|div|span)>"), 1)
    rows = df.select(key, F.posexplode(inner).alias("pos", "_raw")).select(key, "pos", X.trim(X.without_tags(F.col("_raw"))).alias("text"))
    rows = rows.filter((F.length("text") > 0) & (F.length("text") < 200))
    total = rows.groupBy(key).agg(F.count("*").alias("_total"))
    found = rows.groupBy(key, F.lower("text").alias("_same")).agg(F.count("*").alias("n"), F.min_by("text", "pos").alias("text"), F.sort_array(F.collect_list("pos")).alias("positions")).filter(F.col("n") >= least)
    return found.join(total, key).select(key, "text", "n", (F.col("n") / F.col("_total")).alias("confidence"), "positions")


def indicators(found: DataFrame, key: str) -> DataFrame:
    """(key, structure_preserved): the mean confidence of a document's headings, in percent."""
    return found.groupBy(key).agg(X.rounded(F.avg("confidence") * 100).cast("bigint").alias("structure_preserved"))
