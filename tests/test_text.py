import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import arrow as A
from quire.functions import text as X


def value(spark, f, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.select(f(F.col("t")).alias("x"), "k").orderBy("k").collect()]


def test_plain_text_becomes_escaped_paragraphs(spark):
    assert value(spark, X.text_to_html, " a < b \n\n\n c & d ", "", None) == ["<article>\n<p>a &lt; b</p>\n<p>c &amp; d</p>\n</article>", "<article>\n\n</article>", None]


@pytest.mark.parametrize(
    "source, right",
    [
        ("﻿<p>x</p>", "<p>x</p>"),
        ("<p>‘a’ “b” – — …  x</p>", "<p>'a' \"b\" - - ... x</p>"),
        ("<p>hyphen-\nation</p>", "<p>hyphenation</p>"),
        ("<p>line one\nline two</p>", "<p>line one line two</p>"),
        ("<div>line one\nline two</div>", "<div>line one\nline two</div>"),
        ("<p>a    b</p><pre>a    b</pre>", "<p>a b</p><pre>a    b</pre>"),
        ("<p>x  </p>", "<p>x</p>"),
        ("<p>a\x00\x07b</p>", "<p>ab</p>"),
        ("<p>é</p>", "<p>é</p>"),
    ],
)
def test_normalising(spark, source, right):
    assert value(spark, lambda c: X.normalize(c, A.nfc), source) == [right]


@pytest.mark.parametrize(
    "level, source, right",
    [
        ("light", "<p>42</p><p>- 43 -</p><p>Page 12</p><p>page 5 of 100</p><p>x</p>", "<p>x</p>"),
        ("light", "<p>ISBN 978-3-16-148410-0</p>", "<p>ISBN 978-3-16-148410-0</p>"),
        ("light", "a\n\n\n\n\nb", "a\n\nb"),
        ("standard", "<p>ISBN 978-3-16-148410-0</p><p>© 2020 X</p><p>All rights reserved</p><p>Published by Y</p><p>y</p>", "<p>y</p>"),
        ("standard", "<p>In 1984 there were 42000 of them.</p><p>Introduction</p>", "<p>In 1984 there were 42000 of them.</p><p>Introduction</p>"),
        ("aggressive", "<p>***</p><p>===</p><p>x 1</p><p>Abcd1</p><p>ok</p>", "<p>Abcd1</p><p>ok</p>"),
    ],
)
def test_cleaning(spark, level, source, right):
    assert value(spark, lambda c: X.clean(c, level), source, None) == [right, None]


def test_audit_names_what_goes(spark):
    got = value(spark, lambda c: X.audit(c, "standard"), "<p>42</p><p>ISBN 9783161484100</p><p>(c) me</p>\n\n\n\n")[0]
    assert [(r["type"], r["removed"]) for r in got] == [("page_number", "42"), ("whitespace", "(excessive blank lines)"), ("isbn", "ISBN 9783161484100"), ("legal_credit", "(c) me")]


def test_tags_of_the_dialect(spark):
    assert value(spark, X.invalid_tags, "<p><b>x</b><FONT>y</FONT></p>", "<p>x</p>") == [["b", "font"], []]
    assert value(spark, X.strip_disallowed, "<p><b>x</b><a-x>y</p>") == ["<p>x<a-x>y</p>"]


def test_language_by_frequent_words(spark):
    texts = ("the cat sat on the mat and it was not the dog", "o gato que não foi para a casa da sua mãe com uma caixa", "el perro que no está en la casa de los niños con una caja", "two words", "1 2 3 4 5 6 7 8 9 10 11 12", None)
    assert [r and r["language"] for r in value(spark, X.language_scores, *texts)] == ["en", "pt", "es", "unknown", "unknown", None]


def test_markdown_is_stripped(spark):
    assert value(spark, X.strip_markdown, "**b** and [l](u)", "") == ["b and l", ""]


def test_small_measures(spark):
    assert value(spark, X.slug, "A Título: x  y", "日本", None) == ["a-ttulo-x-y", "", "document"]
    assert value(spark, X.author_of, "<p>written by John Smith</p>", "<p>x</p>") == ["John Smith", None]
    assert value(spark, X.last_words, " ".join(map(str, range(30))), "one") == ["27 28 29", "one"]
    assert value(spark, X.count_pattern_tokens, "ab 1234, x!") == [6]


def test_sentences_of_the_chunker():
    n = lambda s: len(A.split_sentences(s))
    assert [n(s) for s in ("One. Two! Three?", "Dr. Smith came.", "A Sra. Lima saiu. Voltou.", "It is 3.14 now. Yes.", "Wait... what? Yes.", "", "See e.g. this. And that.", "Chapter 1. 2 things.")] == [3, 1, 2, 2, 2, 0, 2, 2]
    text = "One.  Two (three). Four"
    assert [text[s["start"] : s["end"]].strip() for s in A.split_sentences(text)] == [s["text"] for s in A.split_sentences(text)]


def test_recognised_text_is_mended():
    got = A.fix_recognised("Entdo isso\n=|=|=|=\na informacao e a Educacao ndo")
    assert got["text"] == "Então isso\na informação e a Educação não" and got["layer1"] >= 3 and got["layer2"] == 2
    assert A.fix_recognised("")["text"] == ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab c.é1", max_size=12), max_size=4))
def test_normalising_twice_changes_nothing(spark, words):
    html = "<p>" + "</p>\n<p>".join(w.strip() for w in words) + "</p>"
    once = value(spark, X.normalize, html)
    assert value(spark, X.normalize, *once) == once


def test_orphans_keep_capitalised_codes(spark):
    cases = {"<p>A123</p>": "", "<p>B747</p>": "", "<p>Ab12</p>": "", "<p>x1   </p>": None, "<p>x 1</p>": None, "<p>A12</p>": None, "<p>7</p>": None, "<P> 12a </P>": None, "<p>abcde1</p>": "", "<p>abc</p>": "", "<p>a123</p>": None}
    for html, gone in cases.items():
        assert value(spark, X.orphans, html)[0] == ("" if gone is None else html), html


def test_audit_of_all_kinds(spark):
    html = "<p>42</p><p>Head</p><p>t</p><p>Head</p>\n\n\n\n<p>ISBN 9783161484100</p><p>(c) me</p><p>x1</p><p>***</p>"
    got = value(spark, lambda c: X.audit(c, "aggressive", F.array(F.lit("Head"), F.lit(""))), html)[0]
    assert [r["type"] for r in got] == ["page_number", "whitespace", "repeated_pattern", "repeated_pattern", "isbn", "legal_credit", "orphan_paragraph", "decorative"]
