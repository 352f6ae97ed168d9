"""Problem 6: continuous paragraphs from the text of scanned pages, with the noise of each line named.

Furniture.  Every line of every page has a place: its distance from the top and from the bottom, its end mark and
its first character.  How often lines of a place come back on other pages of the document is counted over all lines
and gives the place model, which says how far a repeated line, a line like its neighbours' running lines or the title,
a usual shape, or a number is believed there.

Words.  A character editor (averaged perceptron) reads a damaged word and predicts, for each character,
to keep, delete or replace it, or to insert after it; at a hyphen before a line's end it predicts, from the letters
around and from what the vocabulary has of the parts, whether the lines join.  It is trained on pairs that a bounded
sample of pages gives: words unknown to the corpus beside the nearest word of the same document, and joined or kept
hyphens that the sample confirms.  Words that all documents together do not know are candidates; a candidate is misread
if the editor changes it or if a digit or sign stands among its letters.  A word that a hyphen divides at a line's end
is a candidate in its joined form; each half that the repair changes is misread on its own line.

The vocabulary of all documents is a table of hashes and is joined, not broadcast; each distinct word of about a
megabyte of pages is looked up once, with all its places.  Pages are numbered and followed by groups of neighbouring
page numbers, so a document of very many pages meets in no task, and no text is in a window.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import vector as V
from quire.llm.tokens import newest
from quire.plans import bounded_sample, read_table, spread, staged

#: Pages that the editor is trained on at most (those of the smallest hash), and rounds, for hyphens more as they are few.
FIT_PAGES, ROUNDS, HYPHEN_ROUNDS = 600, 3, 12
#: Places from an edge that the place model tells apart, lines that its prior counts as, and the chances from which a
#: line that comes back or looks like one that does, and one that only has the usual shape, is a running line.
#: LIKELY_NUMBER is that of a number.
FAR, PRIOR_LINES, PLAUSIBLE, LIKELY, LIKELY_NUMBER = 6, 6, 0.01, 0.03, 0.15
#: Pages on which a line stands at one place (places may deviate so much) to be a running line wherever that is.
STEADY_PAGES, STEADY = 3, 0.5
#: Pages that are neighbours.
NEIGHBOURS = 64
#: Mentions that make a hyphenated word one of the texts' own; pages that make a shape known.
OWN_HYPHEN, SHAPE_PAGES, SHAPE_SHARE = 4, 12, 0.7
HYPHENS = "-‐‑¬­"
#: Page numbers in print (fixed values), on text whose look-alikes of digits are digits.
PAGE_NUMBER = re.compile(r"^(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|(?:[Pp]age|[Pp]\.|[Pp]g\.|[Ss]eite|[Pp]ágina|[Ss]\.|[Cc]\.|[Сс]тр\.|पृष्ठ|第)?\s*\d{1,4}(?:\s*(?:of|/|de|von|из)\s*\d{1,4})?\s*(?:ページ|页)?|(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))$")
NUMBERED_DOT = re.compile(r"^\d{1,4}\.$")
#: Signs that recognition puts into words (fixed values).
SIGNS = "@#§•^~¢|°¤*$&+=<>\\`"
SIGN_IN_WORD = re.compile(rf"[^\W\d_][{re.escape(SIGNS)}]+[^\W_]|[{re.escape('@#§•^~¢|°¤')}][^\W\d_]|[^\W\d_][{re.escape('@#§•^~¢|°¤')}](?!\w)")
#: Digits that letters are taken for in numbers (fixed values).
AS_DIGIT = str.maketrans("lI|OoSsBZz", "1110055822")
#: Scripts without spaces, whose words lines divide anywhere; there only signs within words show damage.
UNSPACED = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
LETTERS = re.compile(r"[^\W\d_]")
#: A digit among letters.
MIXED = re.compile(r"[^\W\d_]\d|\d[^\W\d_]{2}")


def _marks() -> str:
    """Combining marks as ranges for a pattern, as they belong to words."""
    out, start = [], None
    for c in range(0x300, 0xFE30):
        mark = not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Mn", "Mc")
        if mark and start is None:
            start = c
        elif not mark and start is not None:
            out.append(chr(start) + "-" + chr(c - 1))
            start = None
    return "".join(out)


_WORD = rf"[^\W_]|[{_marks()}]"
WORDS_IN = re.compile(f"(?:{_WORD})+")
TOKEN = re.compile(f"(?:{_WORD})+(?:['’{re.escape(HYPHENS)}](?:{_WORD})+)*")


def words_in(text: str) -> list[str]:
    """Words as the vocabulary has them: runs of letters, marks and digits, in lower case."""
    return WORDS_IN.findall(text.lower())


def hashes(words: list[str | None]) -> pa.Array:
    """The vocabulary's hashes of words; null for null."""
    t = V.Text(pa.array(words, pa.large_string()))
    return pa.array(V.Spans(t.cp).of(t.rows[:-1], t.rows[1:]).astype(np.int64), mask=~t.valid)


def _joined(kind: np.ndarray) -> np.ndarray:
    return np.where((kind == V.DIGIT) | (kind == V.HAN) | (kind == V.KANA), V.LETTER, kind)


def vocabulary(docs: DataFrame, *columns: str) -> DataFrame:
    """(h): the hashes of all words of the given text columns, without repeats within a task."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for column in batch.columns:
                for _, part in V.slices(column):
                    t = V.Text(part)
                    kind = _joined(V.classes()[t.cp])
                    start, end = V.runs(kind, t.rows)
                    word = kind[start] == V.LETTER if len(start) else np.zeros(0, bool)
                    new = np.setdiff1d(np.unique(V.Spans(V.lower_table()[t.cp]).of(start[word], end[word])), seen)
                    if len(new):
                        yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int64))], ["h"])
                        seen = np.union1d(seen, new) if len(seen) < 2_000_000 else new
        return

    return docs.select(*columns).mapInArrow(words, "h bigint").distinct()


# ---- furniture -------------------------------------------------------------------------------------


def page_number(line: str, number: int | None = None) -> bool:
    """Whether a line only gives the page number."""
    s = line.strip()
    if not s or len(s) > 16:
        return False
    if PAGE_NUMBER.match(s):
        return True
    if NUMBERED_DOT.match(s):
        return number is not None and s[:-1] == str(number)
    digits = re.sub(r"(?<![^\W\d_])[lI|OoSsBZz\d]{1,4}(?![^\W\d_])", lambda m: m[0].translate(AS_DIGIT), s)
    framed = not re.fullmatch(r"[^\W_]+\.?", s)  # letters alone are no number, unless a frame says so
    return digits != s and (framed or any(c.isdigit() for c in s)) and bool(PAGE_NUMBER.match(digits))


def core(line: str) -> str:
    """A line without a page number at its ends, in lower case and with single spaces."""
    s = re.sub(r"^\s*\d{1,4}\s{2,}|\s{2,}[\dlIO|]{1,4}\s*$", "", line).strip()
    return re.sub(r"\s+", " ", s).lower()


def shape(line: str) -> str:
    """The kinds of characters of a line's core."""
    s = re.sub(r"^\s*\d{1,4}\s{2,}|\s{2,}\d{1,4}\s*$", "", line).strip()
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", s)
    return re.sub(r"a+", "a", re.sub(r"\d+", "9", s))


LINES = "doc_id bigint, page_key bigint, page_number int, line_no int, top int, bottom int, line string, core bigint, number boolean"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines of pages with their places among the lines that are not blank, from the top and from the bottom."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        cores: list[str] = []
        numbers: list[bool] = []
        for doc, page, number, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            lines = [(k, x) for k, x in enumerate((text or "").split("\n"), 1) if x.strip()]
            for n, (k, x) in enumerate(lines):
                rows.append((doc, page, number, k, n + 1, len(lines) - n, x))
                cores.append(core(x))
                numbers.append(page_number(x, number))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, hashes(cores), pa.array(numbers, pa.bool_())], ["doc_id", "page_key", "page_number", "line_no", "top", "bottom", "line", "core", "number"])


@F.arrow_udf(T.StructType([T.StructField("core", T.StringType()), T.StructField("shape", T.StringType())]))
def _looks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        lines = batch.to_pylist()
        yield pa.StructArray.from_arrays([pa.array([None if x is None else core(x) for x in lines], pa.string()), pa.array([None if x is None else shape(x) for x in lines], pa.string())], ["core", "shape"])


def cell() -> list:
    """What the place model sees of a line: its places from either edge, its end mark and its first character."""
    ended = F.col("line").rlike(r"[.!?,;:。！？、，।]\s*$") | F.col("line").rlike(f"[{re.escape(HYPHENS)}] ?$")
    stands = ~ended & F.col("line").rlike(r"^\s*(?:[\p{Lu}\p{Lo}\d])")
    return [F.least("top", F.lit(FAR)).alias("t"), F.least("bottom", F.lit(FAR)).alias("b"), ended.alias("ended"), stands.alias("stands")]


def place_model(counts: list[tuple[int, int, bool, bool, int, int]]) -> dict[tuple[int, int, bool, bool], float]:
    """The chance that a line of a place comes back on other pages, of (t, b, ended, stands, lines, repeated) counts.

    Pages of few lines say little, so each place begins with its prior.
    """
    out = {}
    for t, b, ended, stands, lines, repeated in counts:
        near = min(t, b)
        prior = (0.0 if ended else 1.0) * (0.5 if near == 1 else 0.25 if near == 2 else 0.02)
        out[t, b, ended, stands] = (repeated + PRIOR_LINES * prior) / (lines + PRIOR_LINES)
    return out


def furniture(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(page_key, line_no, noise): running lines and page numbers.

    Every line of every page has a place.  How often lines of a place come back on other pages of their document is
    counted over all lines and gives the place model; a line is judged by what its place lets expect, by whether its
    core comes back (at one place of three pages or more: wherever that place is), by its likeness to repeated lines of
    neighbouring pages and to the document's title and author, and by whether lines of its shape mostly are such lines.
    """
    spark = pages.sparkSession
    all_lines = staged(pages.select("doc_id", "page_key", "page_number", "text").mapInArrow(_places, LINES), "lines")
    lines = all_lines.filter("not number")
    where = lines.select("doc_id", "page_key", "core", "top", "bottom", F.length(F.trim("line")).alias("size"), *cell()).filter("size >= 4")
    seen = where.groupBy("doc_id", "core").agg(
        F.countDistinct("page_key").alias("n"), F.stddev_pop("top").alias("top"), F.stddev_pop("bottom").alias("bottom"),
    )
    again = staged(seen.filter("n >= 2").select("doc_id", "core", "n", (F.least("top", "bottom") <= STEADY).alias("steady")), "again")
    counted = where.join(again, ["doc_id", "core"], "left").groupBy("t", "b", "ended", "stands").agg(F.count("*").alias("lines"), F.count("n").alias("repeated"))
    model = place_model([tuple(r) for r in counted.collect()])  # at most FAR * FAR * 4 rows
    best = {k[:2]: max(v for x, v in model.items() if x[:2] == k[:2]) for k in model}
    chances = spark.createDataFrame([(*k, float(v), float(best[k[:2]])) for k, v in model.items()], "t int, b int, ended boolean, stands boolean, chance double, place double")
    placed = lines.withColumns({c: x for c, x in zip(("t", "b", "ended", "stands"), cell(), strict=True)}).join(F.broadcast(chances), ["t", "b", "ended", "stands"])
    steady = again.filter(F.col("steady") & (F.col("n") >= STEADY_PAGES)).select("doc_id", "core", F.lit(True).alias("steady"))
    placed = placed.join(steady, ["doc_id", "core"], "left").filter((F.col("place") >= LIKELY) | F.col("steady"))
    bucket = F.coalesce(F.floor(F.col("page_number") / NEIGHBOURS), F.pmod(F.xxhash64("page_key"), F.lit(1024))).cast("bigint").alias("near_pages")
    placed = staged(placed.withColumn("_x", _looks.asNondeterministic()("line")).drop("core").select("*", "_x.core", "_x.shape", bucket).drop("_x", "line"), "placed")
    often = placed.filter((F.col("place") >= LIKELY) & F.col("stands") & (F.length("core") >= 4)).groupBy("doc_id", "core").agg(F.countDistinct("page_key").alias("n"), F.collect_set("near_pages").alias("near"))
    often = often.filter("n >= 2").select("doc_id", "core", F.explode("near").alias("near_pages"))
    often = often.select("doc_id", "core", F.explode(F.array(*[F.col("near_pages") + k for k in (-1, 0, 1)])).alias("near_pages"))
    often = often.groupBy("doc_id", "near_pages").agg(F.collect_set("core").alias("cores"))  # those of 3 * NEIGHBOURS pages
    names = newest(metadata, "doc_id", "updated_at", "title", "author").select("doc_id", F.array_compact(F.array(F.lower("title"), F.lower("author"))).alias("names"))
    judged = placed.join(often, ["doc_id", "near_pages"], "left").join(names, "doc_id", "left")
    every = F.concat(F.coalesce("cores", F.array().cast("array<string>")), F.coalesce("names", F.array().cast("array<string>")))
    like = F.exists(every, lambda x: (F.length(x) >= 4) & (F.levenshtein(F.col("core"), x) <= F.floor(F.length(x) * 0.3)))
    steady = F.coalesce(F.col("steady") & F.col("stands"), F.lit(False))
    judged = staged(judged.withColumn("near", ((like & (F.col("chance") >= PLAUSIBLE)) | steady) & (F.length("core") >= 4)).drop("cores", "names"), "judged")
    shapes = judged.groupBy("shape").agg(F.count("*").alias("lines"), F.sum(F.col("near").cast("int")).alias("good"), F.countDistinct("doc_id").alias("docs"))
    shapes = shapes.filter((F.col("lines") >= SHAPE_PAGES) & (F.col("docs") >= 3) & (F.col("good") >= SHAPE_SHARE * F.col("lines"))).select("shape", F.lit(True).alias("usual"))
    usual = F.col("usual") & (F.length("shape") > 1) & F.col("stands") & (F.length("core") >= 4) & (F.col("chance") >= LIKELY)
    running = judged.join(shapes, "shape", "left").filter(F.col("near") | usual).select("page_key", "line_no", F.lit("running_line").alias("noise"))
    return running.unionByName(_page_numbers(all_lines.filter("number"))).distinct()


def _page_numbers(lines: DataFrame) -> DataFrame:
    """(page_key, line_no, noise) of lines in a page-number format whose place is one of page numbers.

    A place is learnt from numbers that keep their distance from page_number on other pages of the document; numbers
    that keep it on STEADY_PAGES pages need no such place.
    """
    spark = lines.sparkSession
    distance = F.expr("try_cast(regexp_extract(line, '(\\\\d+)', 1) as int)") - F.col("page_number")
    rows = lines.select("doc_id", "page_key", "line_no", *cell()[:2], distance.alias("distance"))
    same = rows.filter("distance is not null").groupBy("doc_id", "distance").agg(F.countDistinct("page_key").alias("n")).filter("n >= 2")
    rows = rows.join(same, ["doc_id", "distance"], "left")
    counts = rows.groupBy("t", "b").agg(F.count("*").alias("lines"), F.count("n").alias("repeated")).collect()  # at most FAR * FAR rows
    model = place_model([(r["t"], r["b"], False, True, r["lines"], r["repeated"]) for r in counts])
    chances = spark.createDataFrame([(*k[:2], float(v)) for k, v in model.items()], "t int, b int, chance double")
    rows = rows.join(F.broadcast(chances), ["t", "b"]).filter((F.col("chance") >= LIKELY_NUMBER) | (F.col("n") >= STEADY_PAGES))
    return rows.select("page_key", "line_no", F.lit("page_number").alias("noise"))


# ---- the editor ------------------------------------------------------------------------------------


def alignment(seen: str, right: str) -> list[str] | None:
    """For each character of the damaged word, what it becomes; None if the words are too far apart."""
    n, m = len(seen), len(right)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                cost[i][j] = i + j
            else:
                cost[i][j] = min(cost[i - 1][j - 1] + (seen[i - 1] != right[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    if cost[n][m] > max(1, min(3, n // 2)):
        return None
    out = [""] * n
    i, j, pending = n, m, ""
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (seen[i - 1] != right[j - 1]):
            out[i - 1] = right[j - 1] + pending
            i, j, pending = i - 1, j - 1, ""
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            out[i - 1], pending = pending, ""
            i -= 1
        else:
            pending = right[j - 1] + pending
            j -= 1
    if pending and out:
        out[0] = pending + out[0]
    return out


@dataclass
class Editor:
    """weights[feature][operation]; the operation "" keeps a character, others say what it becomes ("\\0" nothing).

    At a hyphen before a line's end what the vocabulary has of the two parts are features beside the characters.
    """

    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        w = "\x02\x02" + word + "\x03\x03"
        k = i + 2
        c = w[k]
        kind = "d" if c.isdigit() else "s" if not (c.isalpha() or c in "\n-") else "a"
        around = ("a" if w[k - 1].isalpha() else "x") + ("a" if w[k + 1].isalpha() else "x")
        return ["0" + c, "1" + w[k - 1 : k + 1], "2" + w[k : k + 2], "3" + w[k - 1 : k + 2], "4" + w[k - 2 : k + 1], "5" + w[k : k + 3], "6" + w[k - 2 : k + 3], "7" + kind + around, "8" + kind + around + c]

    def operation(self, features: list[str]) -> str:
        score: dict[str, float] = defaultdict(float)
        score[""] = 0.0
        for f in features:
            for op, w in self.weights.get(f, {}).items():
                score[op] += w
        return max(score, key=lambda op: (score[op], op == "", op))

    def variants(self, word: str) -> list[str]:
        """``edit(word)`` and, best first, all words that differ by one change the editor knows there, or by the best two at neighbouring characters."""
        found: list[tuple[float, str]] = []
        best: list[tuple[float, str]] = []
        for i, c in enumerate(word):
            score: dict[str, float] = defaultdict(float)
            for f in self.features(word, i):
                for op, w in self.weights.get(f, {}).items():
                    score[op] += w
            keep = score.pop("", 0.0)
            changes = [(w - keep, "" if op == "\0" else op) for op, w in score.items()]
            found += [(w, word[:i] + op + word[i + 1 :]) for w, op in changes]
            best.append(max(changes, default=(-1e9, c)))
        found += [(best[i][0] + best[i + 1][0], word[:i] + best[i][1] + best[i + 1][1] + word[i + 2 :]) for i in range(len(word) - 1)]
        return list(dict.fromkeys([self.edit(word)] + [w for s, w in sorted(found, reverse=True) if s > -1e8 and w and w != word]))

    def edit(self, word: str) -> str:
        out = []
        for i, c in enumerate(word):
            op = self.operation(self.features(word, i))
            out.append(c if op == "" else "" if op == "\0" else op)
        return "".join(out)

    @staticmethod
    def join_features(a: str, b: str, known: tuple[bool, bool, bool, bool]) -> list[str]:
        """What is seen at the hyphen between ``a`` and ``b``; ``known``: the joined word, ``a``, ``b``, and the compound."""
        bits = "".join("01"[bool(k)] for k in known)
        small = "s" if b[:1].islower() else "C" if b[:1].isupper() else "o"
        x, y = a.lower()[-3:], b.lower()[:3]
        return ["j", *(f"j{k}{bit}" for k, bit in enumerate(bits)), "ju" + bits[0] + bits[3], "jk" + bits, "jc" + small, f"jm{bits}{small}", f"jn{bits[0]}{bits[3]}{min(len(a), 5)}{min(len(b), 5)}", f"jl{x[-1:]}{y[:1]}", "ja" + x, "jb" + y]

    def joins(self, a: str, b: str, known: tuple[bool, bool, bool, bool]) -> bool:
        """Whether the hyphen goes: the operation for it is to delete it."""
        return self.operation(self.join_features(a, b, known)) == "\0"

    def train(self, pairs: list[tuple[str, list[str]]], hyphens: list[tuple[list[str], bool]] = ()) -> None:
        """Averaged perceptron over the characters of (damaged word, what each becomes) and over (features of a hyphen, joins)."""
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = {}
        step = 0

        def learn(f: list[str], gold: str) -> None:
            got = self.operation(f)
            if got == gold:
                return
            for x in f:
                row = self.weights.setdefault(x, {})
                for op, d in ((gold, 1.0), (got, -1.0)):
                    old = row.get(op, 0.0)
                    total[x, op] += (step - stamp.get((x, op), 0)) * old
                    stamp[x, op] = step
                    row[op] = old + d

        for _ in range(ROUNDS):
            for word, becomes in pairs:
                for i, c in enumerate(word):
                    step += 1
                    learn(self.features(word, i), "" if becomes[i] == c else becomes[i] or "\0")
        for _ in range(HYPHEN_ROUNDS):
            for f, joins in hyphens:
                step += 1
                learn(f, "\0" if joins else "")
        for x, row in self.weights.items():
            for op, w in row.items():
                row[op] = (total[x, op] + (step - stamp.get((x, op), 0)) * w) / max(1, step)


def fit(rows: list[tuple[str, str]]) -> Editor:
    """An editor of (page text, document text) rows.

    A hyphen at a line's end goes if the document has the joined word, and stays if the compound is met undivided; what the vocabulary says of the parts is taken from the other documents, as it will be where a word is new.
    """
    everywhere: Counter = Counter()
    docs: dict[str, tuple[set[str], set[str]]] = {}
    for _, doc in rows:
        if doc not in docs:
            docs[doc] = set(words_in(doc)), {m.lower() for m in TOKEN.findall(doc) if "-" in m}
            everywhere.update(docs[doc][0])
    compounds = Counter(m.lower() for page, _ in rows for x in page.split("\n") for m in TOKEN.findall(x) if "-" in m)
    compounds.update(m for _, own in docs.values() for m in own)
    pairs: list[tuple[str, list[str]]] = []
    hyphens: list[tuple[list[str], bool]] = []
    for page, doc in rows:
        words, own = docs[doc]
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(words):
            by_length[len(w)].append(w)
        lines = [x for x in page.split("\n") if x.strip()]
        for n, line in enumerate(lines):
            tokens = [t for t in words_in(line)]
            if hyphenated(line) and len(line.strip()) > 3 and tokens:
                first = TOKEN.match(lines[n + 1].lstrip()) if n + 1 < len(lines) else None
                if first:
                    a, b = TOKEN.findall(line)[-1], re.split(f"[{re.escape(HYPHENS)}]", first[0])[0]
                    x, y = words_in(a)[-1], (words_in(b) or [""])[0]
                    compound = "-".join([*re.split(f"[{re.escape(HYPHENS)}]", a), *re.split(f"[{re.escape(HYPHENS)}]", first[0])]).lower()
                    stays, goes = compound in own or compounds[compound] > 1, x + y in words
                    if stays != goes:
                        others = tuple(everywhere[w] - (w in words) > 0 for w in (x + y, x, y))
                        hyphens.append((Editor.join_features(x, b, (*others, compounds[compound] - (compound in own) > 1)), goes))
                tokens = tokens[:-1]
            if n and hyphenated(lines[n - 1]):
                tokens = tokens[1:]
            known = 0
            for token in tokens:
                if token in everywhere:
                    if known < 1 and len(token) > 2:
                        pairs.append((token, [*token]))
                        known += 1
                    continue
                if len(token) < 3 or token.isdigit():
                    continue
                letters = {c for c in token if c.isalpha()}
                near = [(a, w) for size in range(len(token) - 2, len(token) + 3) for w in by_length.get(size, ()) if (w[0] == token[0] or w[-1] == token[-1]) and 3 * len(set(w) & letters) >= 2 * len(letters) for a in [alignment(token, w)] if a]
                if near:
                    pairs.append((token, min(near, key=lambda x: (sum(p != q for p, q in zip(x[0], token, strict=True)), x[1]))[0]))
    editor = Editor()
    editor.train(pairs, hyphens)
    return editor


# ---- lines and words -------------------------------------------------------------------------------

#: Words by batch: of each distinct word its places; of WORD rows ``first`` says that a page begins with the word.
#: EDGE rows also hold, for the word at a line's end or start, the hash of both joined and the line that goes on.
WORDS = "role int, h bigint, whole bigint, first boolean, word string, pages array<bigint>, lines array<int>, joined array<bigint>, cut array<int>"
NAMES = ["role", "h", "whole", "first", "word", "pages", "lines", "joined", "cut"]
WORD, EDGE, JOINED, COMPOUND, SIGNED, HALF, PAGE = range(7)


def body_lines(text: str, furniture_: list[int]) -> list[tuple[int, str]]:
    away = set(furniture_ or ())
    return [(k, x) for k, x in enumerate((text or "").split("\n"), 1) if x.strip() and k not in away]


def hyphenated(line: str) -> bool:
    s = line.rstrip()
    return s[-1:] in HYPHENS and s[-1:] != "" and bool(LETTERS.match(s[-2:-1] or "."))


def _unsigned(line: str) -> str:
    """The line without the signs within its words."""
    return SIGN_IN_WORD.sub(lambda m: "".join(c for c in m[0] if c not in SIGNS), line)


def _divided_rows(page: int, k: int, line: str, after: str, page_after: int | None, k_after: int | None) -> list[tuple]:
    """The word that a hyphen divides at the end of ``line``, joined, as a compound and as halves, each half at its line.

    Other words that hang on it (by hyphens or apostrophes) are words of their lines.  A half without another is
    only a candidate for a digit among its letters.
    """

    def judged(w: str) -> bool:
        return bool(LETTERS.search(w)) and not UNSPACED.search(w)

    last, first = TOKEN.findall(_unsigned(line))[-1], TOKEN.match(_unsigned(after.lstrip()))
    a = re.split(f"[{re.escape(HYPHENS)}]", last)
    b = re.split(f"[{re.escape(HYPHENS)}]", first[0]) if first else [""]
    left, right = words_in(" ".join(a)), words_in(" ".join(b))
    x, y = (words_in(a[-1]) or [""])[-1], (words_in(b[0]) or [""])[0]
    whole = "-".join([*a, *b]).lower() if first and len(a) + len(b) > 2 else None
    rows = [(page, k, WORD, w, w, whole) for w in left[: len(left) - bool(x)] if judged(w)]
    if not first:
        return rows + ([(page, k, WORD, x, x, None)] if judged(x) and MIXED.search(x) else [])
    rows += [(page_after, k_after, WORD, w, w, whole) for w in right[bool(y) :] if judged(w)]
    if UNSPACED.search(x + y):
        rows.append((page, k, JOINED, f"{a[-1]}-\n{b[0]}\n\n\n\n", x + y, None))
    else:
        rows += [(where, n, HALF, w, w, None) for where, n, w in ((page, k, x), (page_after, k_after, y)) if judged(w)]
        rows.append((page, k, JOINED, f"{a[-1]}-\n{b[0]}\n{x}\n{y}\n{page_after}\n{k_after}", x + y, None))
    rows.append((page, k, COMPOUND, f"{a[-1]}-\n{b[0]}", "-".join([*a, *b]).lower(), None))
    return rows


def _special(rows: list[tuple]) -> list[pa.Array]:
    """Columns of rows of (page, line, role, word, text of the hash, text of the compound); of JOINED rows ``joined`` has the hashes of both parts."""
    pages, lines, roles, words, of, whole = (list(c) for c in zip(*rows, strict=True)) if rows else ([] for _ in range(6))
    one = pa.array(np.arange(len(rows) + 1, dtype=np.int32))
    none = pa.array(np.zeros(len(rows) + 1, np.int32))
    is_joined = [k for k, role in enumerate(roles) if role == JOINED]
    parts = hashes([x for k in is_joined for x in words[k].split("\n")[2:4]])
    two = np.zeros(len(rows) + 1, np.int32)
    two[np.array(is_joined, np.int64) + 1] = 2
    return [
        pa.array(roles, pa.int32()), hashes(of), hashes(whole), pa.array([False] * len(rows), pa.bool_()), pa.array(words, pa.string()),
        pa.ListArray.from_arrays(one, pa.array(pages, pa.int64())), pa.ListArray.from_arrays(one, pa.array(lines, pa.int32())),
        pa.ListArray.from_arrays(pa.array(np.cumsum(two, dtype=np.int32)), parts), pa.ListArray.from_arrays(none, pa.array([], pa.int32())),
    ]


def _grouped(role: int, low: np.ndarray, start, end, h, whole, first, page, line, joined=None, cut=None) -> list[pa.Array]:
    """Columns of one row for each distinct (hash, compound, first) with the places of all its words."""
    order = np.lexsort((first, whole, h))
    h, whole, first = h[order], whole[order], first[order]
    new = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(whole) != 0) | (np.diff(first.astype(np.int8)) != 0))) if len(h) else np.zeros(0, np.int64)
    at = pa.array(np.append(new, len(h)).astype(np.int32))
    words = [low[start[k] : end[k]].tobytes().decode("utf-32-le", "replace") for k in order[new]]
    none = pa.array(np.zeros(len(new) + 1, np.int32))
    return [
        pa.array(np.full(len(new), role, np.int32)), pa.array(h[new].astype(np.int64)), pa.array(whole[new].astype(np.int64), mask=whole[new] == 0), pa.array(first[new]), pa.array(words, pa.string()),
        pa.ListArray.from_arrays(at, pa.array(page[order].astype(np.int64))), pa.ListArray.from_arrays(at, pa.array(line[order].astype(np.int32))),
        pa.ListArray.from_arrays(at if joined is not None else none, pa.array(joined[order].astype(np.int64) if joined is not None else [], pa.int64())),
        pa.ListArray.from_arrays(at if cut is not None else none, pa.array(cut[order].astype(np.int32) if cut is not None else [], pa.int32())),
    ]


_sets: dict[str, np.ndarray] = {}


def _is(characters: str) -> np.ndarray:
    if characters not in _sets:
        table = np.zeros(0x110000, bool)
        table[[ord(c) for c in characters]] = True
        _sets[characters] = table
    return _sets[characters]


def _page_words(key: np.ndarray, part: pa.Array, away: list) -> Iterator[list[pa.Array]]:
    """The words of a slice of pages that the vocabulary must know, and what needs a closer look, line by line."""
    t = V.Text(part)
    n = len(t.cp)
    if not n:
        return
    kind = V.classes()[t.cp]
    low = V.lower_table()[t.cp]
    hyphen = _is(HYPHENS)[t.cp]
    low = np.where(hyphen, np.uint32(ord("-")), low).astype(np.uint32)
    spans = V.Spans(low)
    # lines: those with ink that are no furniture
    broken = np.zeros(n + 1, np.int64)
    np.cumsum(t.cp == 10, out=broken[1:])
    ink = np.flatnonzero(~((kind == V.SPACE) | (kind == V.BREAK)))
    row = t.row_of(ink)
    number = broken[ink] - broken[t.rows[row]] + 1
    hidden = {r << 24 | k for r, lines in enumerate(away) for k in lines or ()}
    begins = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(number) != 0))) if len(ink) else ink
    l_row, l_no, l_first = row[begins], number[begins], ink[begins]
    l_last = ink[np.append(begins[1:] - 1, len(ink) - 1)] if len(ink) else ink
    body = ~np.isin(l_row << 24 | l_no, np.fromiter(hidden, np.int64, len(hidden))) if hidden else np.ones(len(l_row), bool)
    l_row, l_no, l_first, l_last = l_row[body], l_no[body], l_first[body], l_last[body]
    m = len(l_row)
    if not m:
        return
    letter = np.isin(kind, (V.LETTER, V.HAN, V.KANA))
    cut = hyphen[l_last] & letter[np.maximum(l_last - 1, 0)] & (l_last > l_first)
    follows = np.append(l_row[1:] == l_row[:-1], False)  # the next body line is of the same page
    begun = np.append(False, cut[:-1] & follows[:-1])
    page_first = np.append(True, l_row[1:] != l_row[:-1])
    # words, tokens and the line of each
    start, end = V.runs(_joined(kind), t.rows)
    word = _joined(kind)[start] == V.LETTER
    start, end = start[word], end[word]
    of = np.searchsorted(l_first, start, "right") - 1
    inside = (of >= 0) & (start <= l_last[np.maximum(of, 0)])
    start, end, of = start[inside], end[inside], of[inside]
    w = len(start)
    joint = _is("'’" + HYPHENS)[t.cp]
    linked = np.zeros(w, bool)
    linked[1:] = (start[1:] - end[:-1] == 1) & joint[end[:-1]] & (of[1:] == of[:-1])
    token = np.cumsum(~linked) - 1
    t_start, t_end = start[~linked], end[np.append(~linked[1:], True)] if w else end
    sums = np.zeros((3, n + 1), np.int64)
    unspaced = (kind == V.HAN) | (kind == V.KANA)
    for k, mask in enumerate((letter, unspaced, hyphen)):
        np.cumsum(mask, out=sums[k, 1:])
    lettered, wide = sums[0, end] > sums[0, start], sums[1, end] > sums[1, start]
    whole = np.where(sums[2, t_end] > sums[2, t_start], spans.of(t_start, t_end), 0)[token] if w else np.zeros(0, np.uint64)
    # words at the edges of lines that go on are no words of their own
    first_word = np.append(True, of[1:] != of[:-1]) if w else np.zeros(0, bool)
    line_token = token[np.flatnonzero(first_word)][np.cumsum(first_word) - 1] if w else token  # the first token of each word's line
    opens = (token == line_token) & (t_start[line_token] == l_first[of]) if w else first_word
    last_word = np.append(of[1:] != of[:-1], True) if w else first_word
    last_of_line = token[np.flatnonzero(last_word)][np.cumsum(first_word) - 1] if w else token
    skip = (cut[of] & (token == last_of_line)) | (begun[of] & opens)
    use = ~skip & lettered & ~wide
    first = use & opens & page_first[of]
    h = spans.of(start, end)
    yield _grouped(WORD, low, start[use], end[use], h[use], whole[use].astype(np.uint64), first[use], key[l_row[of[use]]], l_no[of[use]])
    # lines that may go on without a mark: the last word of one and the first of the next, in small letters
    a = np.flatnonzero(last_word & ~skip & ~cut[of] & follows[of] & (end == l_last[of] + 1) & letter[np.maximum(end - 1, 0)] & ~unspaced[np.maximum(end - 1, 0)])
    first_at = np.full(m, -1, np.int64)
    first_at[of[first_word]] = np.flatnonzero(first_word)
    b = first_at[np.minimum(of[a] + 1, m - 1)]
    head = start[np.maximum(b, 0)]
    starts_line = (head == 0) | (t.cp[np.maximum(head - 1, 0)] == 10) | np.isin(head, t.rows)
    ok = (b >= 0) & (head == l_first[np.minimum(of[a] + 1, m - 1)]) & starts_line & _lower()[t.cp[head]]
    a, b = a[ok], b[ok]
    if len(a):
        power, inverse = V.powers(n + 1)
        raw = lambda i: (spans.prefix[end[i]] - spans.prefix[start[i]]) * inverse[start[i]]
        size = end[a] - start[a]
        both = V.mix(raw(a) + raw(b) * power[size] + (size + end[b] - start[b]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = np.concatenate([a, b])
        both, goes_on = np.concatenate([both, both])[~wide[i]], np.concatenate([l_no[of[a]], l_no[of[a]]])[~wide[i]]
        i = i[~wide[i]]
        yield _grouped(EDGE, low, start[i], end[i], h[i], whole[i].astype(np.uint64), np.zeros(len(i), bool), key[l_row[of[i]]], l_no[of[i]], both, goes_on)
    # lines that hold signs, that end in a hyphen, or that begin or end a page
    rows: list[tuple] = []
    line = lambda k: t.string(l_first[k], l_last[k] + 1)
    signs = np.zeros(n + 1, np.int64)
    np.cumsum(_is(SIGNS)[t.cp], out=signs[1:])
    for k in np.flatnonzero(signs[l_last + 1] > signs[l_first]):
        if SIGN_IN_WORD.search(line(k)):
            rows.append((int(key[l_row[k]]), int(l_no[k]), SIGNED, None, None, None))
    for k in np.flatnonzero(cut & follows):
        page = int(key[l_row[k]])
        rows += _divided_rows(page, int(l_no[k]), line(k), line(k + 1), page, int(l_no[k + 1]))
    for k in np.flatnonzero(page_first):
        last = int(np.searchsorted(l_row, l_row[k], "right") - 1)
        rows.append((int(key[l_row[k]]), int(l_no[k]), PAGE, line(k) + (f"\n{l_no[last]}\n{line(last)}" if cut[last] else ""), None, None))
    yield _special(rows)


def _lower() -> np.ndarray:
    if "" not in _sets:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x1F000) if chr(c).islower()]] = True
        _sets[""] = table
    return _sets[""]


def _line_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, away = np.asarray(batch.column(0)), batch.column(2)
        for at, part in V.slices(batch.column(1)):
            for columns in _page_words(key[at : at + len(part)], part, away.slice(at, len(part)).to_pylist()):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, NAMES)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of words that a hyphen divides between pages."""
    for batch in batches:
        rows: list[tuple] = []
        for page, no, line, after, page_after, no_after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            rows += _divided_rows(page, no, line, after or "", page_after, no_after)
        yield pa.RecordBatch.from_arrays(_special(rows), NAMES)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The halves of divided words that their repairs change, or that have a digit among letters, with what they become.

    Columns: page_key, line_no, page_after, line_after, a, b, mended, sure (the vocabulary has it), odd (a half is unknown).
    ``a`` is named "a-" and ``b`` "-b", for the last and the first word of a line.
    """
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for page, line, page_after, line_after, a, b, mended, sure, odd in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not sure and not odd:
                continue
            becomes = alignment(a + b, mended)
            if becomes:
                x, y = "".join(becomes[: len(a)]), "".join(becomes[len(a) :])
            elif mended.startswith(a):
                x, y = a, mended[len(a) :]
            elif mended.endswith(b):
                x, y = mended[: len(mended) - len(b)], b
            else:
                x, y = mended[: len(a)], mended[len(a) :]
            if x != a or (MIXED.search(a + b) and any(c.isdigit() for c in a)):
                rows.append((page, line, a + "-", x))
            if y != b or MIXED.search(b):
                rows.append((page_after, line_after, "-" + b, y))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_key", "line_no", "word", "mended"])


def following(pages: DataFrame, *values: str) -> DataFrame:
    """``pages`` (doc_id, page_number, page_key) with a struct ``follow`` of page_key and ``values`` of the document's next page.

    Windows are by document and NEIGHBOURS page numbers; the first page of each such group is carried to the one before,
    so that a document of very many pages meets in no task.  Pages without a document have no next page.
    """
    group = F.coalesce(F.floor(F.col("page_number") / NEIGHBOURS), F.lit(-1)).alias("_group")
    rows = pages.select("*", group)
    w = W.partitionBy("doc_id", "_group").orderBy("page_number", "page_key")
    head = rows.groupBy("doc_id", "_group").agg(F.min(F.struct("page_number", "page_key", *values)).alias("_head"))
    head = head.select("doc_id", "_group", F.lead("_head").over(W.partitionBy("doc_id").orderBy("_group")).alias("_head"))
    rows = rows.withColumn("follow", F.lead(F.struct("page_number", "page_key", *values)).over(w)).join(head, ["doc_id", "_group"], "left")
    return rows.withColumn("follow", F.when(F.col("doc_id").isNotNull(), F.coalesce("follow", "_head"))).drop("_group", "_head")


@dataclass
class Scan:
    """What is known of the pages: (page_key, line_no, noise), pages with their furniture, and repairs of words."""

    noise: DataFrame
    pages: DataFrame
    repairs: DataFrame
    unknown: DataFrame  # (page_key, line_no, word)
    joins: DataFrame  # (page_key, line_no) of lines that go on within a word
    halves: DataFrame  # (page_key, line_no, word, mended) of damaged halves, as _halves names them


def analyse(pages: DataFrame, docs: DataFrame, metadata: DataFrame) -> Scan:
    """The noise of every line, and what is needed to mend the text.

    Pages of null keys or texts have no noise; repeated rows of a page count once; pages whose document is
    unknown are judged by the words of all others.  A page without text has no lines.
    """
    pages = spread(pages.select("page_key", "doc_id", "page_number", "text", "confidence").filter("page_key is not null and text is not null")).dropDuplicates(["page_key"])
    away = staged(furniture(pages, metadata), "furniture")
    lines = away.groupBy("page_key").agg(F.sort_array(F.collect_set("line_no")).alias("away"))  # lines of a page
    body = pages.join(lines, "page_key", "left").select("page_key", "doc_id", "page_number", "text", F.coalesce("away", F.array().cast("array<int>")).alias("away"))
    body = staged(body, "pages")
    words = staged(body.select("page_key", "text", "away").mapInArrow(_line_words, WORDS), "words")
    # words that a hyphen divides between pages
    ends = words.filter(F.col("role") == PAGE).select(F.col("pages")[0].alias("page_key"), F.col("lines")[0].alias("first_no"), F.split("word", "\n").alias("p"))
    ends = ends.select("page_key", "first_no", F.get("p", F.lit(0)).alias("first_line"), F.expr("try_cast(get(p, 1) as int)").alias("last_no"), F.get("p", F.lit(2)).alias("last_line"))
    ends = following(ends.join(body.select("page_key", "doc_id", "page_number"), "page_key"), "first_line", "first_no")
    ends = staged(ends.filter("last_line is not null").select("page_key", "last_no", "last_line", "follow.first_line", F.col("follow.page_key").alias("page_after"), "follow.first_no"), "ends")
    words = words.unionByName(ends.mapInArrow(_across, WORDS))
    begun = ends.filter("page_after is not null").select(F.col("page_after").alias("page_key")).distinct()
    names = newest(metadata, "doc_id", "updated_at", "title", "author")
    known = staged(vocabulary(spread(docs), "text").unionByName(vocabulary(names, "title", "author")).distinct(), "vocabulary")
    at = lambda *c: F.explode(F.arrays_zip("pages", "lines", *c)).alias("x")
    own = words.filter((F.col("role") == WORD) & F.col("whole").isNotNull()).select("whole", at()).select("whole", "x.pages", "x.lines").distinct()
    own = staged(own.groupBy("whole").count().filter(F.col("count") >= OWN_HYPHEN).select("whole"), "own")
    # words that no document has; each distinct word is looked up once a batch with all its places
    strange = words.filter(F.col("role").isin(WORD, EDGE, HALF)).join(known, "h", "left_anti").join(own, "whole", "left_anti")
    strange = staged(strange.select("role", "first", "word", "pages", "lines", "joined", "cut"), "strange")
    places = lambda role: strange.filter(F.col("role") == role).select("first", "word", at()).select(F.col("x.pages").alias("page_key"), F.col("x.lines").alias("line_no"), "word", "first")
    unknown = places(WORD)
    unknown = unknown.filter("not first").unionByName(unknown.filter("first").join(begun, "page_key", "left_anti")).select("page_key", "line_no", "word")
    # words divided without a mark: together known, and one part not
    bare = strange.filter(F.col("role") == EDGE).select("word", at("joined", "cut")).select(F.col("x.joined").alias("h"), F.col("x.pages").alias("page_key"), F.col("x.lines").alias("line_no"), F.col("x.cut").alias("cut"), "word")
    bare = staged(bare.join(known, "h", "left_semi").drop("h").distinct(), "bare")
    unknown = unknown.join(bare.select("page_key", "line_no", "word"), ["page_key", "line_no", "word"], "left_anti")
    bare = bare.select("page_key", F.col("cut").alias("line_no")).distinct()
    # hyphens at line ends: what the vocabulary has of the joined word and of both parts, and whether the compound is the texts' own
    lookup = words.filter(F.col("role").isin(JOINED, COMPOUND)).select("role", F.col("pages")[0].alias("page_key"), F.col("lines")[0].alias("line_no"), "word", "h", "joined")
    joined = staged(lookup.filter(F.col("role") == JOINED), "joined")
    asked = joined.select("page_key", "line_no", F.posexplode(F.array("h", F.col("joined")[0], F.col("joined")[1])).alias("which", "h")).join(known.withColumn("yes", F.lit(True)), "h")
    has = lambda k: F.max(F.col("which") == k).alias(f"has{k}")
    asked = asked.groupBy("page_key", "line_no").agg(has(0), has(1), has(2))
    compound = lookup.filter(F.col("role") == COMPOUND).join(own.withColumnRenamed("whole", "h"), "h", "left_semi").select("page_key", "line_no", F.lit(True).alias("own"))
    sample = bounded_sample(pages.select("page_key", "doc_id", F.col("text").alias("page")), FIT_PAGES, "page_key")
    rows = sample.join(docs.select("doc_id", F.col("text").alias("doc")), "doc_id").groupBy("page_key").agg(F.first("page").alias("page"), F.max("doc").alias("doc")).orderBy("page_key").collect()
    editor = pages.sparkSession.sparkContext.broadcast(fit([(r["page"], r["doc"]) for r in rows if r["doc"]]))

    @F.arrow_udf(T.BooleanType())
    def goes(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows_ = zip(*[c.to_pylist() for c in columns], strict=True)
            yield pa.array([editor.value.joins((words_in(a) or [""])[-1], b, known_) for a, b, *known_ in rows_], pa.bool_())

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, x, k) for w in batch.column(0).to_pylist() for k, x in enumerate(editor.value.variants(w))]
            words_, found, rank = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(words_, pa.string()), pa.array(found, pa.string()), pa.array(rank, pa.int32()), hashes(list(found))], ["word", "mended", "rank", "h"])

    odd_parts = words.filter((F.col("role") == WORD) & F.col("whole").isNotNull()).join(own, "whole", "left_semi").select("word").distinct()
    odd = staged(places(HALF).drop("first").join(odd_parts, "word", "left_anti").select("page_key", "line_no", "word"), "odd")
    # the editor decides whether the hyphen goes
    place = ["page_key", "line_no"]
    cuts = joined.select(*place, F.split("word", "\n").alias("p")).join(asked, place, "left").join(compound, place, "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("has0", "has1", "has2", "own")]
    cuts = cuts.select(*place, F.col("p")[0].alias("left"), F.col("p")[1].alias("right"), F.col("p")[2].alias("a"), F.col("p")[3].alias("b"), F.expr("try_cast(p[4] as bigint)").alias("page_after"), F.expr("try_cast(p[5] as int)").alias("line_after"), *flags)
    cuts = cuts.withColumn("cut", goes.asNondeterministic()("left", "right", "has0", "has1", "has2", "own"))
    place = ["page_key", "line_no", "a", "b", "page_after", "line_after"]
    cuts = staged(cuts.select(*place, "cut", F.col("has0").alias("joins"), "own"), "cuts")
    # divided words that nobody knows are candidates as one word; beside a hyphen that stays, each half is one
    divided = cuts.filter("cut and not joins and a != ''").select(*place, F.concat("a", "b").alias("word"))
    kept = cuts.filter("not cut and not own").select(F.explode(F.array(F.struct("page_key", "line_no", F.col("a").alias("word")), F.struct(F.col("page_after").alias("page_key"), F.col("line_after").alias("line_no"), F.col("b").alias("word")))).alias("x")).select("x.*")
    unknown = unknown.unionByName(odd.join(kept, ["page_key", "line_no", "word"], "left_semi"))
    # the editor's proposals, and which of them the vocabulary has
    proposals = staged(unknown.select("word").unionByName(divided.select("word")).distinct().repartition(2 * pages.sparkSession.sparkContext.defaultParallelism).mapInArrow(variants, "word string, mended string, rank int, h bigint"), "proposals")
    good = proposals.join(known, "h", "left_semi").groupBy("word").agg(F.min_by("mended", "rank").alias("known"))
    repairs = proposals.filter("rank = 0").select("word", "mended").join(good, "word", "left")
    mixed = F.col("word").rlike(r"\p{L}\d|\d\p{L}\p{L}")
    repairs = repairs.filter(F.col("known").isNotNull() | (F.col("mended") != F.col("word")) | mixed).select("word", F.coalesce("known", "mended").alias("mended"), F.col("known").isNotNull().alias("sure"))
    repairs = staged(repairs, "repairs")
    misread = unknown.join(repairs, "word", "left_semi").select("page_key", "line_no")
    misread = misread.unionByName(words.filter(F.col("role") == SIGNED).select(F.col("pages")[0].alias("page_key"), F.col("lines")[0].alias("line_no")))
    # a divided word that is damaged: by the halves that show it
    odd = odd.select("word").distinct()
    odd_a, odd_b = (odd.select(F.col("word").alias(c), F.lit(True).alias("odd_" + c)) for c in "ab")
    halves = divided.join(repairs, "word").join(odd_a, "a", "left").join(odd_b, "b", "left")
    halves = halves.select("page_key", "line_no", "page_after", "line_after", "a", "b", "mended", "sure", (F.col("odd_a").isNotNull() | F.col("odd_b").isNotNull()).alias("odd")).mapInArrow(_halves, "page_key bigint, line_no int, word string, mended string")
    text_lines = misread.unionByName(halves.select("page_key", "line_no")).distinct().join(away.select("page_key", "line_no"), ["page_key", "line_no"], "left_anti").withColumn("noise", F.lit("misread"))
    noise = away.unionByName(cuts.filter("cut").select("page_key", "line_no").unionByName(bare.select("page_key", "line_no")).withColumn("noise", F.lit("cut_word"))).unionByName(text_lines).distinct()
    joins = cuts.filter("cut").select("page_key", "line_no").unionByName(bare.select("page_key", "line_no")).distinct()
    return Scan(noise, body, repairs, unknown, joins, halves)


PIECES = "doc_id bigint, page_number int, page_key bigint, idx int, piece string, last boolean, ended boolean"
ENDED = re.compile(r"[.!?。！？।…:][\"'”’“»)」』）]*\s*$")


def _as_seen(seen: str, mended: str) -> str:
    return mended.upper() if seen.isupper() and len(seen) > 1 else mended[:1].upper() + mended[1:] if seen[:1].isupper() else mended


def _repaired(line: str, repairs: dict[str, str]) -> str:
    """The line with its words mended; "-b" is the first word of the line and "a-" the last, as halves."""
    places = [m.start() for m in WORDS_IN.finditer(line)]

    def mended(m: re.Match) -> str:
        word = m[0].lower()
        names = ["-" + word] * (m.start() == places[0]) + [word + "-"] * (m.start() == places[-1]) + [word]
        return next((_as_seen(m[0], repairs[x]) for x in names if x in repairs), m[0])

    return WORDS_IN.sub(mended, line)


def mend_page(text: str, away: list[int], repairs: dict[int, dict[str, str]], joins: set[int]) -> list[str]:
    """The paragraphs of a page; each ends with a space unless its last line goes on within a word."""
    out, now, hidden = [], "", set(away or ())
    for k, line in enumerate(text.split("\n"), 1):
        if k in hidden:
            continue
        if not line.strip():
            out, now = (out + [now], "") if now else (out, "")
            continue
        line = _unsigned(line.strip())
        if repairs.get(k):
            line = _repaired(line, repairs[k])
        unspaced = bool(UNSPACED.search(line[-1:]))
        now += line.rstrip(HYPHENS + " ") if k in joins else line if unspaced or hyphenated(line) else line + " "
    return out + [now] if now else out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
    for batch in batches:
        rows = []
        for doc, number, page, text, away, fixes, joins in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            by_line: dict[int, dict[str, str]] = defaultdict(dict)
            for f in fixes or ():
                by_line[f["line_no"]][f["word"]] = f["mended"]
            found = mend_page(text, away, by_line, set(joins or ()))
            rows += [(doc, number, page, k, x, k == len(found) - 1, bool(ENDED.search(x))) for k, x in enumerate(found)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "page_number", "page_key", "idx", "piece", "last", "ended"])


def paragraphs(scan: Scan) -> DataFrame:
    """(doc_id, paragraph, first_page, last_page, text): the mended text of documents, page after page.

    A page whose text does not end a sentence goes on with the next page's first paragraph.  Repairs and joins
    are gathered by page, pieces are joined by paragraph, so no task holds a whole document.
    """
    fixes = scan.unknown.join(scan.repairs.drop("sure"), "word").unionByName(scan.halves)
    fixes = fixes.groupBy("page_key").agg(F.collect_set(F.struct("line_no", "word", "mended")).alias("fixes"))
    joins = scan.joins.groupBy("page_key").agg(F.collect_set("line_no").alias("joins"))
    pages = scan.pages.filter("doc_id is not null").join(fixes, "page_key", "left").join(joins, "page_key", "left")
    pieces = staged(pages.select("doc_id", "page_number", "page_key", "text", "away", "fixes", "joins").mapInArrow(_pieces, PIECES), "pieces")
    # each page's first paragraph and number of paragraphs, summed by groups of pages first; no text is in a window
    group = F.coalesce(F.floor(F.col("page_number") / NEIGHBOURS), F.lit(-1)).alias("_group")
    by_page = pieces.groupBy("doc_id", "page_number", "page_key").agg(F.count("*").alias("n"), F.max(F.col("last") & ~F.col("ended")).alias("open"))
    goes_on = following(by_page).filter("open and follow is not null").select(F.col("follow.page_key").alias("page_key"), F.lit(1).alias("goes_on"))
    by_page = by_page.join(goes_on, "page_key", "left").select("doc_id", "page_number", "page_key", group, F.coalesce("goes_on", F.lit(0)).alias("goes_on"), "n")
    new = F.col("n") - F.col("goes_on")
    groups = by_page.groupBy("doc_id", "_group").agg(F.sum(new).alias("n"))
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("doc_id", "_group", F.coalesce(F.sum("n").over(before(W.partitionBy("doc_id").orderBy("_group"))), F.lit(0)).alias("_base"))
    order = before(W.partitionBy("doc_id", "_group").orderBy("page_number", "page_key"))
    by_page = by_page.withColumn("_in", F.coalesce(F.sum(new).over(order), F.lit(0))).join(groups, ["doc_id", "_group"])
    first = by_page.select("page_key", (F.col("_base") + F.col("_in") + 1 - F.col("goes_on")).alias("_first"))
    numbered = pieces.join(first, "page_key").withColumn("paragraph", F.col("_first") + F.col("idx"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "page_key", "idx", "piece"))), lambda x: x["piece"]), "")
    return numbered.groupBy("doc_id", "paragraph").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.trim(whole).alias("text"))


def low_confidence(pages: DataFrame, threshold: float = 60.0) -> DataFrame:
    """(doc_id, pages, mean_confidence, low_pages): pages named whose confidence is null or under the threshold; repeated rows once."""
    rows = pages.select("doc_id", "page_number", "confidence").distinct()
    low = F.coalesce(F.col("confidence") < threshold, F.lit(True))
    return rows.groupBy("doc_id").agg(F.countDistinct("page_number").alias("pages"), F.avg("confidence").alias("mean_confidence"), F.array_join(F.sort_array(F.collect_set(F.when(low, F.col("page_number")))), ",").alias("low_pages"))


def _scan(spark: SparkSession, sf_dir: str) -> Scan:
    return analyse(read_table(spark, sf_dir, "ocr_pages"), read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "document_metadata"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).noise.select("page_key", "line_no", "noise")


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(_scan(spark, sf_dir))


def p6_low_confidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = low_confidence(read_table(spark, sf_dir, "ocr_pages"))
    return rows.select("doc_id", "pages", F.round("mean_confidence", 6).alias("mean_confidence"), "low_pages")


SQL = {
    "p6_low_confidence_pages": """
        SELECT doc_id, count(DISTINCT page_number) AS pages, round(avg(confidence), 6) AS mean_confidence,
          coalesce(array_to_string(list_sort(list(DISTINCT page_number) FILTER (coalesce(confidence < 60, true))), ','), '') AS low_pages
        FROM (SELECT DISTINCT doc_id, page_number, confidence FROM ocr_pages) GROUP BY doc_id""",
}
