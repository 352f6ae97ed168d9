import random
import base64
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import forms, packing, tokens
from quire.llm import vector as V

PIECES = {b"a": -3.0, b"b": -3.2, b"ab": -4.0, b"abc": -4.5, b"bc": -4.1, b"c": -3.3, b" ": -2.0, b" a": -3.5, b"aba": -20.0}


def best_path(s: bytes) -> int:
    """Pieces on the best path, by trying all."""
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(s)
    for i in range(len(s)):
        for p, w in PIECES.items():
            if s.startswith(p, i) and best[i][0] + w > best[i + len(p)][0]:
                best[i + len(p)] = (best[i][0] + w, best[i][1] + 1)
    return best[-1][1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc ", min_size=1, max_size=20), min_size=1, max_size=6))
def test_counts_are_those_of_all_paths(words):
    trie = tokens.DoubleArray(PIECES)
    assert trie.counts([w.encode() for w in words]).tolist() == [best_path(w.encode()) for w in words]


def test_long_segments_and_unknown_bytes():
    trie = tokens.DoubleArray(PIECES)
    assert trie.counts([b"ab" * 500]).tolist()[0] == 500
    assert trie.counts([b""]).tolist() == [0]


def test_counting_rows(spark):
    rows = spark.createDataFrame([(1, "Hello, world"), (2, None), (3, ""), (4, "Hello, world"), (5, "長い文章 " * 9000)], "k int, t string")
    got = [r["n_tokens"] for r in tokens.count_tokens(rows.withColumn("n_tokens", F.lit("old")), "t").orderBy("k").collect()]
    assert got[0] == got[3] > 0 and got[1] is None and got[2] == 0 and got[4] > 9000
    assert tokens.count_tokens(rows.limit(0), "t").count() == 0


def test_judged_counts(spark):
    text = "The parser checks two nearly equal drafts before the export starts."
    rows = [(k, 1, 13, text) for k in range(20)] + [(30, 1, None, text), (31, 1, 0, text), (32, 1, 50, text), (33, 1, 3, text), (30, 1, None, text), (34, None, 13, None)]
    got = tokens.judged_chunks(spark.createDataFrame(rows, "chunk_key bigint, doc_id bigint, token_count int, content string").withColumn("script", F.lit(1))).collect()
    assert sorted(r["chunk_key"] for r in got if not r["trusted"]) == [30, 31, 32, 33, 34] and len(got) == 25


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ("EN", "pt-BR", "Español", "en_GB", "und", "", None, "xx", "日本語", "zho")], "l string")
    assert [r[0] for r in rows.select(tokens.language_code(F.col("l"))).collect()] == ["en", "pt", "es", "en", None, None, None, None, "ja", "zh"]


def test_exact_counts_equal_the_tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    sys.path.insert(0, "/opt/py313/lib/python3.13/site-packages")
    pt = pytest.importorskip("public_tokenizers")
    path = pt.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    right = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["it's l'export 're x  y\n\n z\t\tq 'doctor  ", "", "a b  　c 12ab½Ⅳ it'll we've 'S", "  lead", "tab\tx", "दो मिलते", "長い文。次", "\n", "'s", "x 's", "a'll'll"]
    ours = packing.Exact(path).numbers(pa.array(texts))
    assert ours.tolist() == [len(right.encode_ordinary(t)) for t in texts]


# ---- forms -----------------------------------------------------------------------------------------


def form(text, markup=False):
    return forms.canonical(pa.array([text]), markup).to_pylist()[0] or text


def test_forms():
    cases = {
        "ｆｕｌｌ": "full", "ﬁn​d": "find", "a b c": "a b c", "é": "é", "pаssаge": "passage", "⼈口": "人口",
        "сcылка": "ссылка", "soft­hyphen": "softhyphen", "ｶﾞ": "ガ", "x²": "x²", "क्‍ष": "क्‍ष", "a‍b": "ab", "plain": "plain", "": "",
    }
    assert {k: form(k) for k in cases} == cases
    assert form("&eacute;&#233;&nbsp;&lt;b&#62; x & y", True) == "éé &lt;b&gt; x & y"
    assert forms.canonical(pa.array([None, "x"], pa.string())).to_pylist() == [None, None]


@settings(max_examples=60, deadline=None)
@given(st.text("aẹ́̂ö̧céạ ", max_size=14))
def test_composition_is_that_of_unicode(text):
    assert form(text) == unicodedata.normalize("NFC", text)


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=20))
def test_a_form_is_final(text):
    text = text.encode("utf-8", "ignore").decode()
    assert form(form(text)) == form(text)


def test_pairs_that_look_the_same(spark):
    rows = [(1, "café one"), (2, "café one"), (3, "café one"), (4, "café one"), (5, "cafe one"), (6, "Café one"), (2, "café one"), (7, None), (None, "café​ one"), (8, "")]
    df = spark.createDataFrame(rows, "chunk_key bigint, content string").withColumn("k", F.lit(1)).withColumn("raw", F.lit(1))
    got = {(r["key_a"], r["key_b"]) for r in forms.same_look(df, "chunk_key", "content", "content").collect()}
    distinct = {k: t for k, t in rows if k is not None and t is not None}
    want = {(a, b) for a in distinct for b in distinct if a < b and distinct[a] != distinct[b] and form(distinct[a]) == form(distinct[b])}
    assert got == want == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert forms.same_look(df.limit(0), "chunk_key", "content", "content").count() == 0


def test_texts_and_back():
    texts = ["aé中\U0001f600", "", "x"]
    t = V.Text(pa.array(texts))
    assert V.to_array(t.cp, t.rows).to_pylist() == texts
    whole = V.Text(pa.array(["xx", None, "ab", "cab"]).slice(1))
    assert len(whole) == 3 and whole.valid.tolist() == [False, True, True]
    spans = V.Spans(whole.cp).of(np.array([0, 3]), np.array([2, 5]))
    assert spans[0] == spans[1] == V.hash_of("ab")


def test_long_segments_have_the_best_path(monkeypatch):
    """Segments of any length are scored whole, in lockstep or alone, as the plain recursion scores them."""
    rng = random.Random(5)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))).encode(): -rng.random() * 9 for _ in range(60)} | {c.encode(): -6.0 for c in "abc"}
    trie = tokens.DoubleArray(pieces)

    def plain(s: bytes) -> int:
        best = [(0.0, 0)]
        for j in range(1, len(s) + 1):
            best.append(max(((best[i][0] + pieces[s[i:j]], -(best[i][1] + 1)) for i in range(max(0, j - 5), j) if s[i:j] in pieces), default=(-1e30, 0)))
            best[-1] = (best[-1][0], -best[-1][1])
        return best[-1][1]

    long = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (10, 300, 700, 1500, 4000)]
    want = [plain(s) for s in long]
    assert trie.counts(long).tolist() == want
    monkeypatch.setattr(tokens, "LONG", 200)
    assert trie.counts(long).tolist() == want
    monkeypatch.setattr(tokens, "LONG", 4096)
    monkeypatch.setattr(tokens, "CELLS", 1000)
    assert trie.counts(long).tolist() == want
