import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import language, sentences
from quire.llm import vector as V
from tests.conftest import DATA


def test_held_out_language_samples():
    rows = pd.read_parquet(f"{DATA}/language_samples.parquet").sort_values("sample_id")
    place = rows.groupby("language").cumcount()
    train, test = rows[place < 6], rows[place >= 6]
    model = language.fit(list(zip(train.language, train.text, strict=True)))
    scorer = language.Scorer(model)
    got = [x["language"] for x in language._detect(model, scorer, pa.array(test.text.tolist(), pa.large_string())).to_pylist()]
    assert sum(a == b for a, b in zip(got, test.language, strict=True)) / len(test) >= 0.95


def test_segments_of_mixed_text(spark):
    samples = spark.read.parquet(f"{DATA}/language_samples.parquet")
    en = "The reading room compares the running titles. The parser checks the marginal notes of the old edition."
    de = "Der Katalog beschreibt die gescannten Deckblätter. Die Archivarin prüft die Randnotizen der älteren Ausgabe."
    rows = [(1, f"{en}\n\n{de}"), (2, en), (3, None), (4, ""), (5, "1234 5678"), (6, en), (7, "The reading room."), (8, (en + " ") * 400)]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("detected", F.lit(1)).withColumn("language", F.lit("x"))
    got = {r["k"]: r["detected"] for r in language.detect_languages(df, samples).select("k", "detected").collect()}
    assert [s["language"] for s in got[1]["segments"]] == ["en", "de"]
    first = got[1]["segments"][0]
    assert rows[0][1][first["start"] : first["end"]] == en
    assert got[2] == got[6] and got[2]["language"] == "en" and 0 < got[2]["confidence"] <= 1
    assert got[3] is None and got[4] is None and got[5] is None and got[7]["language"] == "en" and len(got[8]["segments"]) == 1
    assert language.detect_languages(df.limit(0), samples).count() == 0
    empty = language.detect_languages(df, samples.limit(0)).filter("detected is not null")
    assert empty.count() == 0


TEXTS = [
    ("Dr. Orv says that it is so. The parser checks it.", 2),
    ("The mean rose to 3.14 pages, i.e. well above. See Fig. 4 and vol. 2 of it. J. K. Lun and Mrs. Tus agree.", 3),
    ("Velun noted: \"It checks the page. Nothing else matters.\" in the margin. The end came.", 2),
    ("\"The parser checks it.\" The board left. (The glossary too.) It ended", 4),
    ("The board left.The parser stayed. What then? Nothing!", 4),
    ("One line\ngoes on here. Second.\n\nNew paragraph without mark\n\nLast one.", 4),
    ("目録は結合した表を直す。解析器は「表を直す。ほかは要らない。」と書いた。終わり", 3),
    ("दूसरा समीक्षक लिखता है। अनुवादक चुनता है।", 2),
]


def model():
    rows = pd.read_parquet(f"{DATA}/sections.parquet")
    more = pd.read_parquet(DATA.replace("sf0.001", "sf0.01") + "/sections.parquet")
    return sentences.fit([*rows.content.tolist(), *more.content.tolist()])


def test_sentences_of_many_kinds(spark):
    m = model()
    row, start, end = sentences.split(m, pa.array([t for t, _ in TEXTS], pa.large_string()))
    assert [int((row == k).sum()) for k in range(len(TEXTS))] == [n for _, n in TEXTS]
    rows = [(k, t) for k, (t, _) in enumerate(TEXTS)] + [(90, None), (91, ""), (92, " \n\n "), (93, TEXTS[0][0] + "\n\n" + "x " * 50_000)]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("sentences", F.lit(0))
    got = {r["k"]: r["sentences"] for r in sentences.with_sentences(df, "t", model=m).collect()}
    assert got[90] is None and got[91] == [] and got[92] == [] and len(got[93]) == 3
    for k, (t, _) in enumerate(TEXTS):
        ends = [s["end"] for s in got[k]]
        assert ends == sorted(set(ends)) and ends[-1] == len(t.rstrip()) and all(not t[s["start"]].isspace() for s in got[k])
        assert "".join(t.split()) == "".join("".join(t[s["start"] : s["end"]].split()) for s in got[k])
    assert sentences.with_sentences(df.limit(0), "t", model=m).count() == 0


def test_text_without_marks_is_cut_where_sentences_end():
    text = "目録は結合した表を直す解析器は読みの順序を比べる閲覧室は地名の索引を説明する書庫の係員は章の番号を捨てる審査会は旧版の脚注を数える索引の担当班は柱の文字を説明する目録は結合した表を直す解析器は読みの順序を比べる閲覧室は地名の索引を説明する書庫の係員は章の番号を捨てる"
    _, start, end = sentences.split(model(), pa.array([text], pa.large_string()))
    right = sum(text[e - 1] in "すぶるえ" for e in end)
    assert len(end) >= 5 and right / len(end) >= 0.7


def test_viterbi_in_lockstep_is_that_of_one_sequence():
    import numpy as np

    rng = np.random.default_rng(1)
    move = rng.normal(size=(4, 2, 2)).astype(np.float32)
    sequence = np.repeat(np.arange(30), rng.integers(1, 9, 30))
    score, gap = rng.normal(size=len(sequence)).astype(np.float32), rng.integers(0, 4, len(sequence))
    want = [x for s in range(30) for x in sentences._path(score[sequence == s].tolist(), gap[sequence == s].tolist(), move)]
    assert sentences._viterbi(score, sequence, gap, move).astype(int).tolist() == want


def test_short_paragraphs_without_marks_are_cut_by_a_chain():
    pool = ["图书馆员每天早上检查目录", "修复的手稿保留着页边注释", "编辑悄悄改正了索引的错误", "仓库的温度由报告记录下来"]
    rng = np.random.default_rng(5)
    texts = ["".join(pool[k] + "。" for k in rng.permutation(4)) for _ in range(60)]
    model = sentences.fit(texts)
    _, _, end = sentences.split(model, pa.array([pool[2] + pool[0] + pool[3]], pa.large_string()))
    assert end.tolist() == [12, 24, 36]
    cut = dataclasses.replace(model, bare_move=np.where(np.arange(2)[None, None, :] == 1, -1e6, 0.0) * np.ones((4, 2, 2)))
    assert sentences.split(cut, pa.array([pool[2] + pool[0]], pa.large_string()))[2].tolist() == [24]


def test_models_learn_from_all_texts_of_a_large_table(spark):
    """An abbreviation that only texts of the greatest hashes hold is known, whatever the layout; repeats count once."""
    rng = np.random.default_rng(3)
    pool = ["The parser checks page {} of the ledger.", "The board left the hall at noon.", "Nothing else came in box {} of the cellar.", "It ended well."]
    plain = [(" ".join(pool[x] for x in rng.permutation(4)).format(k, k + 1),) for k in range(5400)]
    rare = spark.createDataFrame([(f"The clerk met Prov. Lunmar in room {k} of the cellar. It ended well.",) for k in range(2000)], "t string")
    last = [(r["t"],) for r in rare.orderBy(F.xxhash64("t").desc()).limit(60).collect()]
    df = spark.createDataFrame([*plain, *last, *last[:5]], "t string")
    models = [sentences.fit_texts(x, "t") for x in (df.coalesce(1), df.union(df).repartition(7))]
    for a, b in zip(*(dataclasses.astuple(m) for m in models), strict=True):
        assert np.array_equal(a, b)
    got = sentences.with_sentences(df, "t").filter("t like '%Prov.%'").select(F.size("sentences").alias("n")).collect()
    assert len(got) == 65 and {r["n"] for r in got} == {2}


def test_tables_without_texts_or_marks(spark):
    for rows in ([], [(None,), ("",), (" \n",)], [("no mark at all",), ("目録",)]):
        got = sentences.with_sentences(spark.createDataFrame(rows, "t string"), "t").collect()
        assert [None if r["sentences"] is None else len(r["sentences"]) for r in got] == [None if t is None else int(bool(t.strip())) for (t,) in rows]


def test_the_second_chain_learns_from_all_paragraphs():
    pools = [["图书馆员每天早上检查目录", "修复的手稿保留着页边注释", "编辑悄悄改正了索引的错误"], ["ねこはにわでねむっていた", "いぬはかわをわたってきた", "とりはそらをたかくとんだ"]]
    rng = np.random.default_rng(7)
    texts = ["".join(pools[n >= 310][k] + "。" for k in rng.permutation(3)) for n in range(620)]
    _, _, end = sentences.split(sentences.fit(texts), pa.array(["".join(pools[1][k] for k in (2, 0, 1))], pa.large_string()))
    assert end.tolist() == [12, 24, 36]


def test_evidence_needs_more_points_in_more_shards():
    """A name that misses the ends of paragraphs by chance is no abbreviation in a large table; a rare slip does not hide one."""
    kind, key = np.array([sentences.ALL, sentences.WORD, sentences.WORD, sentences.WORD]), np.array([sentences.POINTS, 11, 12, 13], np.uint64)
    there, against = np.array([10_000, 9, 500, 500]), np.array([2_700, 0, 1, 90])
    assert sentences.evidence(kind, key, there, against).abbreviations.tolist() == [11, 12]
    assert sentences.evidence(kind, key, there, against, 40).abbreviations.tolist() == [12]


def test_unknown_languages_are_rejected(spark):
    """Languages that no sample has, and noise, get no language; the count of sentences is that of the text."""
    samples = spark.read.parquet(f"{DATA}/language_samples.parquet")
    unknown = [
        "Kirjasto on avoinna joka päivä kello kymmenestä kuuteen ja lukija palauttaa kirjat ajoissa.", "Ang wikang Tagalog ay isa sa mga pangunahing wika ng Pilipinas.",
        "Ez a könyvtár minden nap nyitva van reggel kilenctől este hatig.", "Kütüphane her gün sabah dokuzdan akşam altıya kadar açıktır.",
        "Η βιβλιοθήκη είναι ανοιχτή κάθε μέρα από τις εννέα.", "xq zvkj wqpt rrtk blmn vvxz qqpw",
    ]
    known = ["The parser marks the page images. The catalogue keeps the scanned cover sheets.", "Der Parser ordnet die Bildunterschriften auf Wunsch der Bücherei."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(unknown + known)], "id int, text string")
    got = {r["id"]: r["detected"] for r in language.detect_languages(df, samples).collect()}
    assert [k for k in range(len(unknown)) if got[k] is not None] == []
    en, de = got[len(unknown)], got[len(unknown) + 1]
    assert (en["language"], en["sentences"], en["segments"][0]["sentences"]) == ("en", 2, 2)
    assert (de["language"], de["sentences"], de["segments"][0]["sentences"]) == ("de", 1, 1)


def test_sums_of_words_equal_those_of_their_grams(spark):
    rows = [(r["language"], r["text"]) for r in spark.read.parquet(f"{DATA}/language_samples.parquet").collect()]
    scorer = language.Scorer(language.fit(rows))
    words = ["a", "parser", "目录", "カタログ", "नमस्ते", "übermaß"]
    t = V.Text(pa.array([" ".join(words)]))
    start, end = language._words(t)
    want = np.stack([scorer.table[language._grams(t.string(a, b))].sum(axis=0) for a, b in zip(start, end, strict=True)])
    assert np.allclose(scorer._of(V.lower_table()[t.cp], start, end), want, rtol=1e-4, atol=1e-3)
