import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import leakage, residue, scans
from quire.llm import vector as V


# ---- leaked passages -------------------------------------------------------------------------------

PASSAGE = "In Caddru, the clerk joins the fragments of the Eldvel bequest, a point Mioulm raised on sheet 1119. The room near Gralrin rebuilds the footnotes kept by Tabkel, as Miobor recorded in ledger 6766. Around 94, Lunkel joins the page images at Lirsar, as Rincad recorded in ledger 74."


def edited(text):
    words = text.split()
    words[3], words[20] = "derk", "teh"
    return " ".join(w for k, w in enumerate(words) if k % 11 != 7).upper().replace(",", "")


def test_leaks(spark):
    items = spark.createDataFrame([(1, "Read the passage below.\n" + PASSAGE), (2, None), (3, ""), (4, "One sentence only of some words."), (1, "Read the passage below.\n" + PASSAGE)], "item_id bigint, text string").withColumn("doc_id", F.lit(5))
    first, second, third = leakage.sentences_of(PASSAGE)
    noise = "The catalogue lists the marginal notes of the older edition without touching the original file. "
    rows = [(10, noise * 5 + PASSAGE + noise), (11, noise + edited(PASSAGE)), (12, noise + first), (13, first + " " + noise * 30 + third), (14, f"{second} {third}"), (15, noise * 40), (16, None), (17, ""), (10, noise * 5 + PASSAGE + noise), (18, "Read the passage below. " + noise)]
    docs = spark.createDataFrame(rows + [(100 + k, noise + str(k)) for k in range(50)], "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    got = {(r["item_id"], r["doc_id"]) for r in leakage.find_leaks(docs, items).collect()}
    assert got == {(1, 10), (1, 11), (1, 14)}
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0


def test_leaks_without_spaces(spark):
    text = "図書館員は第三棚の目録を毎朝確認する。修復された写本には余白の注記が残っている。編集者は索引の誤りを静かに訂正した。"
    assert len(leakage.sentences_of(text)) == 3
    items = spark.createDataFrame([(1, "次の文章を読みなさい。\n" + text)], "item_id bigint, text string")
    first, second, third = leakage.sentences_of(text)
    noise = "この報告は倉庫の温度と湿度を記録したものである。"
    docs = spark.createDataFrame([(10, noise + first + second + noise), (11, noise * 3), (12, noise + first)], "doc_id bigint, text string")
    assert {(r["item_id"], r["doc_id"]) for r in leakage.find_leaks(docs, items).collect()} == {(1, 10)}


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISS), h[i - 1, j] + leakage.GAP, h[i, j - 1] + leakage.GAP)
    return h.max()


def test_block_alignment_scores():
    rng = np.random.default_rng(3)
    docs, items = [rng.integers(0, 6, rng.integers(1, 25)) for _ in range(20)], [rng.integers(0, 6, rng.integers(1, 12)) for _ in range(20)]
    d, i = np.full((20, 25), 98, np.uint64), np.full((20, 12), 99, np.uint64)
    for k in range(20):
        d[k, : len(docs[k])] = docs[k]
        i[k, : len(items[k])] = items[k]
    score, met = leakage.align(d, np.array([len(x) for x in docs]), i, np.array([len(x) for x in items]))
    assert score.tolist() == [smith_waterman(items[k], docs[k]) for k in range(20)]
    assert (met.sum(axis=1) * leakage.MATCH >= score).all()


# ---- template residue ------------------------------------------------------------------------------


#: Records of three templates with the same names in other slots, in syntaxes that nobody told the operator.
FORMS = ["Dear ⟦first name⟧, your order ~id~ of {{date}} is on its way.", "Dear {{date}}, your order ⟦id⟧ of ~first name~ is on its way.", "Written for ~date~ by {{id}}", "Written for ⟦id⟧ by ⟦date⟧", "Kept for {{first name}} only", "Kept for ~id~ only"]


def test_slots_are_induced(spark):
    filled = ["Dear Maria Lun, your order 7 of 3 May is on its way.", "Written for Zon by Mar", "Kept for readers only"]
    real = "The *board* of [Zon{k}] keeps <b>drafts</b> of entry {k}, as «Mio{k}» wrote in part «two»."
    rows = [(k, f) for k, f in enumerate(FORMS)]
    rows += [(10, "A new letter for {{id}} and ⟦date⟧ that has no other record"), (11, "A new letter for [id] whose signs no record has"), (12, "A letter for {{somebody}} else")]
    rows += [(20 + k, f + " This one was sent by Zonlun.") for k, f in enumerate(filled)]
    rows += [(30 + k, real.replace("{k}", "abcdefghij"[k] * 3)) for k in range(10)]
    rows += [(50, real.replace("{k}", "xy") + "\n\n{{date}}"), (51, "{{date}}"), (52, "<p>text</p>\n<p>more</p>")]
    rows += [(60 + k, f"Form sent to ____ in year {k}") for k in range(2)] + [(62, "Form kept by ____ until ~date~"), (63, "Form kept by {{id}} until ____"), (64, "Form sent to ~date~ in year 5")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue_documents(docs).collect()} == {0, 1, 2, 3, 4, 5, 10, 51, 60, 61, 62, 63, 64}


def test_defaults_in_slots(spark):
    rows = [(k, f) for k, f in enumerate(FORMS)] + [(10 + k, "Sent with regards to {{Valued Customer}} of ours") for k in range(4)] + [(20, "Sent with regards to {{Maria Lun}} of ours")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue_documents(docs).collect()} == {0, 1, 2, 3, 4, 5, 10, 11, 12, 13}


def test_long_pages_of_one_kind(spark):
    page = "\n".join(f"The reader could not {w} this page because the store behind it gave no answer in time." for w in "open load find show start fetch render resolve draw list build send reach fill".split())
    rows = [(k, f) for k, f in enumerate(FORMS)] + [(10 + k, page) for k in range(6)] + [(20, "\n".join(FORMS[k % 6] for k in range(290)))]
    assert len(page) > 1200 and len(rows[-1][1]) > 10_000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue_documents(docs).collect()} == {0, 1, 2, 3, 4, 5, 20, *range(10, 16)}


def test_residue(spark):
    real = "The parser of Zonlun checks the drafts of entry {k}. The board of Povtus keeps them, as Mio{k} wrote. " * 6
    rows = [(k, "A title\n\n" + real.replace("{k}", str(k))) for k in range(30)]
    rows += [(100 + k, f"Menu | Back | Help\nPage not available, code {k + 400}\n\n(c) Some Archive, build {k}") for k in range(5)]
    rows += [(200, "Title: X\n\nDear {{first_name}},\n\nYour order <%= id %> of ${date} is on its way."), (201, "Dear [INSERT NAME], from __COMPANY__")]
    signs = ("{{%s}}", "<%%= %s %%>", "${%s}", "[INSERT %s]", "__%s__")
    fields = [x % n for x in signs for n in ("first_name", "id", "date", "company", "name")]
    rows += [(210 + k, f"Dear {a}, from {fields[k * 7 % 25]}" if k % 2 else f"Sent to {a} by {fields[k * 7 % 25]}") for k, a in enumerate(fields)]
    rows += [(300 + k, "Lorem ipsum dolor amet. Veniat aliqua fugiat laborum ipsum lorem. " * 8) for k in range(3)]
    rows += [(400, "This short text is real and is found once only."), (401, "The manual explains {{ name }} in a long and real sentence of its own.\n\nThat is all there is, and it is real, by Zonlun."), (402, None), (403, ""), (100, rows[30][1]), (None, "x")]
    rows += [(404, real.replace("{k}", "7") + "\n\nPage not available, code 404")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit(1)).withColumn("h", F.lit(1))
    got = {r["doc_id"]: r["reason"] for r in residue.residue_documents(docs).collect()}
    assert set(got) == {100, 101, 102, 103, 104, 200, 201, *range(210, 235), 300, 301, 302}
    assert got[300] == "filler" and got[100] == "template"
    left = residue.without_residue(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 36
    assert residue.residue_documents(docs.limit(0)).count() == 0


def test_residue_of_any_length(spark):
    real = "The parser of Zonlun checks the drafts of entry Mio{k}. The board of Povtus keeps them, as Tab{k} wrote. "
    rows = [(k, "A title\n\n" + "".join(real.replace("{k}", "abcdefghij"[k % 10] * (k + n + 2)) for n in range(6))) for k in range(30)]
    rows += [(100 + k, "Menu | Back\n\n" + "Insert your paragraph here.\n" * n + "\n(c) Some Archive") for k, n in enumerate((2, 17, 400))]
    notice = "\n".join(f"Please let this page {w} before it can be shown to you in the browser of your choice." for w in "load settle start open answer resume finish connect".split())
    rows += [(200 + k, "Notice\n\n" + notice) for k in range(3)]
    rows += [(300, "\n".join(f"Dear {{{{name}}}}, clause {'abcdefgh'[k % 8] * (k % 31 + 1)} of the long form." for k in range(248))), (301, "Insert your paragraph here.\n" * 30 + "But this sentence of Zonlun is real.")]
    rows += [(400 + k, f) for k, f in enumerate(("Dear {{name}}, hello", "Dear {{date}}, hello", "Thanks, {{date}}", "Thanks, {{name}}"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue_documents(docs).collect()} == {100, 101, 102, 200, 201, 202, 300, 400, 401, 402, 403}


def test_units():
    t = V.Text(pa.array(["One two. Three!\n\nfour", "", "甲。乙"]))
    s, e = residue.units(t.cp, t.rows)
    assert [t.string(a, b) for a, b in zip(s, e, strict=True)] == ["One two", "Three", "four", "甲", "乙"]


# ---- scanned pages ---------------------------------------------------------------------------------


def test_page_numbers():
    yes = ("4", "- 12 -", "— 3 —", "[7]", "Page 8", "p. 3", "3/9", "4 of 12", "iv", "l0/1l", "[l]")
    assert all(scans.page_number(x) for x in yes) and scans.page_number("5.", 5)
    assert not any(scans.page_number(x) for x in ("5.", "box 13.", "O", "", "In 1984", "Zonlun 96-A", "civil"))


def test_editor_learns_confusions():
    words = "request library publisher board until catalogue describes numbers collection edition".split()
    pairs = []
    for w in words * 3:
        pairs.append((w, [*w]))
        for a, b in (("s", "5"), ("i", "1"), ("e", "c")):
            if a in w:
                bad = w.replace(a, b, 1)
                pairs.append((bad, [*w]))
    editor = scans.Editor()
    editor.train(pairs)
    damaged = {"reque5t": "request", "l1brary": "library", "dcscribes": "describes", "publi5her": "publisher"}
    assert all(right in editor.variants(bad) for bad, right in damaged.items())
    assert editor.edit("reque5t") == "request"


def test_all_changes_are_looked_up():
    editor = scans.Editor({"0e": {"c": 9.0, "o": 8.0}, **{"0" + c: {"x": 5.0} for c in "abdfghijkl"}, "0m": {"n": -3.0}})
    found = editor.variants("abdfghijklme")
    assert "abdfghijklmo" in found and "abdfghijklne" in found and len(found) == len(set(found))


def test_alignment():
    assert scans.alignment("rn0del", "model") == ["m", "", "o", "d", "e", "l"] or "".join(scans.alignment("rn0del", "model")) == "model"
    assert scans.alignment("abc", "xyz") is None and "".join(scans.alignment("cat", "cart")) == "cart"


def test_pages_are_mended():
    got = scans.mend_page("Head\nThe par5er low-\nconfidence Cov¢er is di-\nvided.\n\nNext", [1], {2: {"par5er": "parser"}}, {3})
    assert got == ["The parser low-confidence Cover is divided. ", "Next "]


def test_noise_of_pages(spark):
    clean = "The reading room compares the running titles of the older edition. The parser describes the marginal notes. The catalogue keeps the scanned cover sheets of the collection. "
    docs = spark.createDataFrame([(1, clean * 3), (2, clean)], "doc_id bigint, text string")
    meta = spark.createDataFrame([(1, "Shelf marks: Zonlun 12", "Mio Tus", 1), (1, "old", None, 0)], "doc_id bigint, title string, author string, updated_at int")
    pages = [
        (1, 1, 1, "Shelf marks: Zonlun 12    1\nThe reading room compares the run-\nning titles of the older edition.\n\nZonlun 7-A", 90.0),
        (2, 1, 2, "2  Mio Tus\nThe par5er describes the marginal notes.\nZonlun 7-A\n[2]", 50.0),
        (3, 1, 3, "SHELF MARKS: ZONLUN 12\nThe catalogue keeps the sca•nned cover sheets\nof the collection.\nZonlun 7-A", None),
        (4, 2, 1, None, 10.0), (5, 2, 2, "", 10.0), (6, None, 1, "The catalogue", 1.0), (None, 1, 9, "x", 1.0),
    ]
    df = spark.createDataFrame(pages + pages[:1], "page_key bigint, doc_id bigint, page_number int, text string, confidence double").withColumn("noise", F.lit(1))
    scan = scans.analyse(df, docs, meta)
    got = {(r["page_key"], r["line_no"], r["noise"]) for r in scan.noise.collect()}
    want = {(1, 1, "running_line"), (1, 2, "cut_word"), (1, 5, "running_line"), (2, 1, "running_line"), (2, 2, "misread"), (2, 3, "running_line"), (2, 4, "page_number"), (3, 1, "running_line"), (3, 2, "misread"), (3, 4, "running_line")}
    assert got == want
    texts = [r["text"] for r in scans.paragraphs(scan).filter("doc_id = 1").orderBy("paragraph").collect()]
    assert texts[0] == "The reading room compares the running titles of the older edition."
    assert texts[-1] == "The catalogue keeps the scanned cover sheets of the collection." and len(texts) == 3
    low = {r["doc_id"]: r["low_pages"] for r in scans.low_confidence(df).collect()}
    assert low[1] == "2,3,9" and low[2] == "1,2"
    assert scans.analyse(df.limit(0), docs, meta).noise.count() == 0


def test_damage_in_either_half_of_a_divided_word(spark):
    clean = "The reading room compares the running titles of the older edition. The parser describes the marginal notes. The catalogue keeps the scanned cover sheets of the collection. "
    docs = spark.createDataFrame([(1, clean * 3)], "doc_id bigint, text string")
    meta = spark.createDataFrame([], "doc_id bigint, title string, author string, updated_at int")
    pages = [
        (1, 1, 1, "The parscr dcscribes the notcs of the\nolder edition the parser de-\n\nscribcs the marginal run-\nning titles of the colle-\nction the dcs-\ncribes notes of the cata-\nl0gue of the older edi-", 90.0),
        (2, 1, 2, "tion. The parser compares the covcr shccts\nof the older edition.\nThe parser keeps the col-", 90.0),
        (3, 1, 3, "lcction of the older edition. The\nolder edition keeps it.", 90.0),
    ]
    df = spark.createDataFrame(pages, "page_key bigint, doc_id bigint, page_number int, text string, confidence double")
    scan = scans.analyse(df, docs, meta)
    got = {(r["page_key"], r["line_no"]) for r in scan.noise.filter("noise = 'misread'").collect()}
    assert got == {(1, 1), (1, 4), (1, 6), (1, 8), (2, 1), (3, 1)}
    text = " ".join(r["text"] for r in scans.paragraphs(scan).orderBy("paragraph").collect())
    assert "scribes the marginal running titles of the collection the describes notes of the cata" in text and "scribcs" not in text


def test_halves_are_mended_only_at_the_edges():
    got = scans.mend_page("in dc de-\nscribcs in dc", [], {1: {"de-": "de"}, 2: {"-scribcs": "scribes", "dc": "de"}}, {1})
    assert got == ["in dc describes in de "]


def test_the_editor_decides_joins(spark, monkeypatch):
    """The same pages, with an editor that keeps the hyphen: the line is no cut word, and the text keeps it."""
    clean = "The reading room compares the running titles of the older edition. "
    docs = spark.createDataFrame([(1, clean * 3)], "doc_id bigint, text string")
    meta = spark.createDataFrame([], "doc_id bigint, title string, author string, updated_at int")
    pages = spark.createDataFrame([(1, 1, 1, "The reading room compares the run-\nning titles of the older edition.", 90.0)], "page_key bigint, doc_id bigint, page_number int, text string, confidence double")
    found = lambda: {(r["line_no"], r["noise"]) for r in scans.analyse(pages, docs, meta).noise.collect()}
    assert (1, "cut_word") in found()
    monkeypatch.setattr(scans, "fit", lambda rows: scans.Editor({"j": {"": 9.0, "\0": -9.0}}))
    assert (1, "cut_word") not in found()


def test_joins_follow_the_vocabulary_and_the_compound():
    doc = "The parser compares the catalogue entries. The running titles of the half-title page keep the well-known order. "
    page = "The parser compares the cata-\nlogue entries. The run-\nning titles of the half-\ntitle page keep the well-\nknown order of the half-title and the well-known page."
    editor = scans.fit([(page, doc + x) for x in ("a", "b", "c", "d")])
    assert editor.joins("regis", "ter", (True, False, False, False)) and not editor.joins("cross", "reference", (False, True, True, True))


def test_a_header_of_three_lines(spark):
    """The third line of a header that stands on every page is found by its place, far from where the model expects one."""
    body = "the parser {a} reads the marginal notes of sheet {a} in the\nold hand, and {b} keeps what the clerk of the archive wrote\nabout box {b}, since nobody else had kept the list of it\nin the rooms of {a}, where the cover sheets had been put."
    words = "Zonlun Miotus Tabek Orvar Pelsin".split()
    rows = [(k, 1, k, "Shelf marks of the archive\nSecond survey\nCopy for readers\n" + body.replace("{a}", w).replace("{b}", w[::-1].lower()), 90.0) for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, body)], "doc_id bigint, text string")
    meta = spark.createDataFrame([], "doc_id bigint, title string, author string, updated_at int")
    pages = spark.createDataFrame(rows, "page_key bigint, doc_id bigint, page_number int, text string, confidence double")
    found = {(r["page_key"], r["line_no"]) for r in scans.furniture(pages, meta).collect()}
    assert found == {(k, n) for k in range(5) for n in (1, 2, 3)}


def test_next_page_of_groups(spark):
    """The next page is the same as one window by document gives, across groups of pages and repeated numbers."""
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(0, 400, 3)])) for k in range(300)]
    df = spark.createDataFrame(rows, "page_key bigint, doc_id bigint, page_number int")
    got = {r["page_key"]: r["follow"] and r["follow"]["page_key"] for r in scans.following(df).collect()}
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], -1 if r[2] is None else r[2], r[0]))
    want = {r[0]: None for r in rows} | {a[0]: b[0] for a, b in zip(order[:-1], order[1:], strict=True) if a[1] == b[1]}
    assert got == want


def test_leaks_in_runs_and_long_chains(spark, monkeypatch):
    """Test items in several runs, and a document that repeats a passage very often, give what one run gives."""
    rng = random.Random(9)
    item = lambda: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(9)).capitalize() + "."
    items = [(k, " ".join(item() for _ in range(3))) for k in range(4)]
    docs = [(10, "Some words before. " + items[0][1] + " Some after."), (11, (items[1][1] + " ") * 300), (12, "Nothing of it here at all."), (13, items[2][1].upper() + " " + items[3][1])]
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda: {(r["item_id"], r["doc_id"]) for r in leakage.find_leaks(a, b).collect()}
    assert found() == {(0, 10), (1, 11), (2, 13), (3, 13)}
    monkeypatch.setattr(leakage, "MAX_ITEM_CHARACTERS", 400)
    assert found() == {(0, 10), (1, 11), (2, 13), (3, 13)}
