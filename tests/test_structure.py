import random

from pyspark.sql import functions as F

from quire.functions.html import markdown, standard_html
from quire.operators import chunking, export, quality, structure


def cut(spark, *html):
    return structure.blocks(spark.createDataFrame(list(enumerate(html)), "k int, html string"), "k", "html")


def heads(spark, *html):
    return [(r["level"], r["text"], r["source"], r["confidence"]) for r in structure.headings(cut(spark, *html), "k").orderBy("k", "ordinal").collect()]


def test_headings_by_source(spark):
    html = "<h1>A</h1><p>1. One</p><p>1.1. Sub</p><p>II. Roman</p><p>INTRODUCTION</p><p>Capítulo 3</p><p>plain text</p><h2></h2><p>" + "A" * 101 + "</p>"
    assert heads(spark, html) == [(1, "A", "html-tag", 1.0), (1, "1. One", "numbering", 0.7), (2, "1.1. Sub", "numbering", 0.7), (1, "II. Roman", "numbering", 0.7), (2, "INTRODUCTION", "uppercase", 0.5), (1, "Capítulo 3", "linguistic", 0.8)]
    assert heads(spark, "", None) == []


def test_sections_are_cut_at_headings(spark):
    got = structure.sections(cut(spark, "<p>before</p><h1>A</h1><p>x</p><h2>B</h2><p>y</p>", "<p>flat</p>"), "k").orderBy("k", "seq").collect()
    assert [(r["k"], r["seq"], r["level"], r["title"], r["html"]) for r in got] == [(0, 1, 1, "A", "<p>x</p>"), (0, 2, 2, "B", "<p>y</p>"), (1, 1, 1, "Document", "<p>flat</p>")]


def tree_by_stack(levels):
    """Ids, parents and depths as a stack of open sections gives them."""
    out, stack, counts = [], [], [0] * 7
    for seq, level in enumerate(levels, 1):
        counts[level] += 1
        counts[level + 1 :] = [0] * (6 - level)
        while stack and stack[-1][1] >= level:
            stack.pop()
        name = "-".join(p + str(counts[k]) for k, p in enumerate(structure.PREFIXES, 1) if k <= level and counts[k])
        out.append((seq, name, stack[-1][0] if stack else None, len(stack) + 1))
        stack.append((seq, level))
    return out


def test_tree_equals_a_stack(spark):
    rng = random.Random(5)
    docs = [[rng.randint(1, 6) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    rows = [(k, n, level, f"t{n}") for k, levels in enumerate(docs) for n, level in enumerate(levels)]
    got = structure.section_tree(spark.createDataFrame(rows, "k int, ordinal int, level int, text string"), "k").orderBy("k", "seq").collect()
    want = [(k, *x) for k, levels in enumerate(docs) for x in tree_by_stack(levels)]
    assert [(r["k"], r["seq"], r["id"], r["parent_seq"], r["depth"]) for r in got] == want


def test_repeated_blocks(spark):
    html = "<p>Head</p><p>a</p><p>HEAD</p><p>b</p><div>head</div><p>c</p>"
    got = structure.repeated_blocks(spark.createDataFrame([(1, html), (2, "<p>x</p>"), (3, None)], "k int, html string"), "k", "html").collect()
    assert [(r["k"], r["text"], r["n"], r["confidence"]) for r in got] == [(1, "Head", 3, 0.5)]


def test_markdown_of_each_element():
    cases = {
        "<h3>T</h3>": "### T", "<p>a\n b</p>": "a b", "<p>a<br>b</p>": "a\nb", "<hr>": "---", "<p><strong>x</strong> <i>y</i></p>": "**x** *y*", '<a href="u">t</a>': "[t](u)",
        "<ul><li>a<li>b</ul>": "- a\n- b", "<ol><li>a</li><li>b</li></ol>": "1. a\n2. b", "<blockquote>q</blockquote>": "> q", "<pre><code>x = 1</code></pre>": "```\nx = 1\n```",
        "<p>a <code>c</code></p>": "a `c`", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>": "| a | b |\n| --- | --- |\n| 1 |  |", "": "",
    }
    assert {k: markdown(k) for k in cases} == cases


def test_html_to_the_dialect():
    source = '<html lang="pt"><head><title> T </title><meta name="author" content="A"></head><body><script>"</p>"</script><nav>n</nav><p class="x" id="i">a<b>b</b><p>c</body></html>'
    assert standard_html(source) == ('<p id="i">ab</p><p>c</p>', "T", "A", "pt")


def blocks(*contents):
    return [{"content": c, "chapter": "C", "section": None} for c in contents]


def test_chunks_of_one_and_many():
    count = lambda s: len(s.split())
    o = chunking.ChunkOptions(10, 40, 30)
    assert [c["content"] for c in chunking.fold(blocks("Just one."), o, count)] == ["Just one."]
    text = " ".join(f"This is the sentence of number {k}." for k in range(20))
    many = chunking.fold(blocks("", text, "The end. It is."), o, count)
    assert len(many) > 3 and many[0]["overlap_tokens"] == 0 and all(c["overlap_tokens"] > 0 for c in many[1:])
    assert many[1]["content"].startswith("This is the sentence of number 3.\n\n")
    seen = " ".join(c["content"] for c in many)
    assert all(f"number {k}." in seen for k in range(20))


def test_structures_stay_whole():
    count = lambda s: len(s.split())
    code = "```\n" + "\n".join(f"x{k} = {k}" for k in range(30)) + "\n```"
    items = "\n".join(f"- item {k}" for k in range(12))
    got = chunking.fold(blocks(f"Before it all.\n\n{code}\n\nBetween. Them.\n\n{items}"), chunking.ChunkOptions(5, 40, 30, "none"), count)
    assert any(code == c["content"] for c in got) and any(items in c["content"] for c in got)


def test_chunk_rows(spark):
    rows = spark.createDataFrame([(1, 2, "b", "C", None), (1, 1, "a", "C", None), (2, 1, " ", None, None), (3, 1, None, None, None)], "k int, seq int, content string, chapter string, section string")
    got = chunking.chunks(rows, "k").orderBy("k", "index").collect()
    assert [(r["k"], r["index"], r["chunk_id"], r["total"], r["content"]) for r in got] == [(1, 0, "chunk-001", 2, "a"), (1, 1, "chunk-002", 2, "b")]
    assert chunking.chunks(rows.limit(0), "k").count() == 0


def test_list_runs(spark):
    rows = spark.createDataFrame([(1, "- a\n- b\nx\n1. c"), (2, None)], "k int, t string")
    assert sorted((r["run_no"], r["n_lines"]) for r in chunking.list_runs(rows, "k", "t").collect()) == [(1, 2), (2, 1)]


def test_scores_are_bounded(spark):
    rows = spark.createDataFrame([(1, 750, 0, "a", "b"), (1, 750, 10, "a", None), (2, 10, None, None, None), (3, None, None, None, None)], "k int, token_count int, overlap_tokens int, chapter string, section string")
    got = {r["k"]: r for r in quality.chunk_measures(rows, "k").collect()}
    assert got[1]["consistency"] == 100 and got[2]["consistency"] == 0 and got[3]["n_chunks"] == 1
    one = spark.range(1).select(quality.overall(F.lit(90), F.lit(None), F.lit(80)).alias("x"), quality.structure_score(F.lit(90), F.lit(True), F.lit(3)).alias("y")).first()
    assert (one["x"], one["y"]) == (75, 63)


def test_export_strings(spark):
    rows = spark.createDataFrame([(1, 2, "B", "**y**"), (1, 1, "Document", "x"), (1, 3, None, " ")], "k int, seq int, title string, content string")
    assert export.section_markdown(rows, "k").first()["body"] == "x\n\n**y**\n\n"
    assert export.section_text(rows, "k").first()["body"] == "x\n\nB\n\ny\n"
