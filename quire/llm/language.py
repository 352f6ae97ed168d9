"""Problem 2: one language with a confidence for each document, and for each segment of mixed ones.

Nearest-centroid classification.  Character n-grams of words (with their edges marked) are
weighted by TF-IDF; the training sentences of each language are clustered into a few centroids
by spherical k-means; a text has the language of the centroid of greatest cosine.  A text farther
from it than held-out text of that language and of its length is rejected and gets no language.

The n-grams of a text are those of its words, so a text's product with a centroid is the sum of
its words' products.  A worker keeps, for each distinct word met, the products with all centroids
and a signed projection of its vector; the sums over a sentence give the products and, from the
projection, the length that the cosine needs.  Sentences are found and summed for a whole batch
at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import vector as V
from quire.llm.residue import residue_documents
from quire.llm.tokens import language_code
from quire.plans import read_table, spread

#: Labelled rows that a model is fitted on at most (those of the smallest keys), n-gram lengths, hashed features.
FIT_ROWS, NGRAMS, FEATURES = 20_000, (1, 2, 3, 4), 1 << 15
#: Centroids of a language, and width of the projection.
CLUSTERS, PROJECTION = 3, 128
#: Words remembered by a worker.
KEEP = 150_000
#: A text is rejected if its cosine is so many standard deviations below the mean of held-out text of its language and
#: length; the lengths in letters, and the share of the training rows that are held out to learn these cosines.
#: The deviation counts as SPREAD of the mean at least, as few rows show little of it.
REJECT, SPREAD, LENGTHS, HELD_OUT = 3.5, 0.08, (12, 25, 50, 100), 4
#: Words whose n-grams are gathered at a time.
WORDS_TOGETHER = 4000
#: A line without an end mark counts as a heading up to this many characters.
HEADING = 70
#: Confidence below which a sentence goes with the one before it, and that of sentences under SHORT characters.
CLEAR, SHORT_CLEAR, SHORT = 0.12, 0.22, 64
CLOSERS = "\"'”“»’)]）」』】"


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    centroids: np.ndarray  # (FEATURES, centroids), columns of length 1, times idf
    idf: np.ndarray
    least: np.ndarray  # (languages, LENGTHS): the cosine from which text is of the language


def _grams(word: str) -> np.ndarray:
    """Hashed n-grams of a word; ideographs and kana have no edges."""
    wide = V.classes()[ord(word[0])] in (V.HAN, V.KANA)
    text = word if wide else f"\x02{word}\x03"
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    spans, out = V.Spans(cp), []
    for n in NGRAMS[: 3 if wide else None]:
        if len(cp) >= n:
            start = np.arange(len(cp) - n + 1)
            out.append(spans.of(start, start + n) >> np.uint64(64 - FEATURES.bit_length() + 1))
    return np.concatenate(out).astype(np.int64)


def _words(text: V.Text) -> tuple[np.ndarray, np.ndarray]:
    kind = V.classes()[text.cp]
    start, end = V.runs(kind, text.rows)
    first = kind[start] if len(start) else kind
    word = (first == V.LETTER) | (first == V.HAN) | (first == V.KANA)
    return start[word], end[word]


def _vectors(rows: list[tuple[str, str]], names: list[str], letters: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts, language) of the sentences of (language, text) rows, or of their beginnings of so many letters."""
    vectors, owner = [], []
    for lang, text in rows:
        t = V.Text(pa.array([text.lower()], pa.large_string()))
        start, end = sentences(t)
        ws, we = _words(t)
        for a, b in zip(start, end, strict=True):
            mine = np.flatnonzero((ws >= a) & (we <= b))
            if letters is not None:
                total = np.cumsum(we[mine] - ws[mine])
                if not len(mine) or total[-1] < letters:
                    continue
                mine = mine[: int(np.searchsorted(total, letters)) + 1]
            grams = [_grams(t.string(ws[k], we[k])) for k in mine]
            if grams:
                vectors.append(np.bincount(np.concatenate(grams), minlength=FEATURES).astype(np.float32))
                owner.append(names.index(lang))
    return (np.stack(vectors) if vectors else np.zeros((0, FEATURES), np.float32)), np.asarray(owner, np.int64)


def _clusters(x: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idf, centroids, their languages) by spherical k-means within each language."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = x * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centroids, of = [], []
    for k in range(many):
        mine = x[owner == k]
        if not len(mine):
            continue
        seeds = [mine.mean(axis=0)]
        while len(seeds) < min(CLUSTERS, len(mine)):  # the farthest sentence starts the next cluster
            seeds.append(mine[np.argmin((mine @ np.stack(seeds).T / np.linalg.norm(seeds, axis=1)).max(axis=1))])
        c = np.stack(seeds)
        for _ in range(12):
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
            near = (mine @ c.T).argmax(axis=1)
            c = np.stack([mine[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        centroids.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9))
        of += [k] * len(c)
    return idf, np.concatenate(centroids), np.asarray(of)


def fit(rows: list[tuple[str, str]]) -> Model:
    """Centroids from (language, text) rows.

    Every HELD_OUT-th row of a language is first held out; how near such text of several lengths comes to the centroids
    of the others is the distance from which texts are rejected.  A language of fewer rows is judged by its own rows.
    """
    rows = sorted({(lang, text) for lang, text in rows if lang and text})
    names = sorted({lang for lang, _ in rows})
    x, owner = _vectors(rows, names)
    if not len(x):
        return Model([], np.zeros(0, np.int64), np.zeros((FEATURES, 0), np.float32), np.ones(FEATURES, np.float32), np.zeros((0, len(LENGTHS))))
    number = {lang: 0 for lang in names}
    train, held = [], []
    for lang, text in rows:
        number[lang] += 1
        (held if number[lang] % HELD_OUT == 0 else train).append((lang, text))
    few = {lang for lang in names if number[lang] < HELD_OUT}
    held += [r for r in train if r[0] in few]
    idf, centroids, of = _clusters(*_vectors(train, names), len(names))
    least = np.ones((len(names), len(LENGTHS)))
    for j, letters in enumerate(LENGTHS):
        y, whose = _vectors(held, names, letters)
        y = y * idf
        cosine = (y @ centroids.T) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
        for k in range(len(names)):
            mine = cosine[whose == k][:, of == k]
            near = mine.max(axis=1) if len(mine) else None
            least[k, j] = max(0.0, near.mean() - REJECT * max(near.std(), SPREAD * near.mean())) if len(mine) > 1 else least[k, j - 1] if j else 0.0
    least = np.minimum.accumulate(least[:, ::-1], axis=1)[:, ::-1]  # longer text comes no less near
    idf, centroids, of = _clusters(x, owner, len(names))
    return Model(names, of, (centroids.T * idf[:, None]).astype(np.float32), idf, least)


_tables: dict[str, np.ndarray] = {}


def _flags(cp: np.ndarray, characters: str) -> np.ndarray:
    if characters not in _tables:
        _tables[characters] = np.zeros(0x110000, bool)
        _tables[characters][[ord(c) for c in characters]] = True
    return _tables[characters][cp]


_upper: list[np.ndarray] = []


def _starts_sentence() -> np.ndarray:
    """Characters that can begin a sentence: capitals, letters of scripts without case, digits, opening marks."""
    if not _upper:
        out = np.zeros(0x110000, bool)
        for c in range(0x20000):
            kind = unicodedata.category(chr(c)) if not 0xD800 <= c < 0xE000 else ""
            out[c] = kind in ("Lu", "Lt", "Lo", "Nd", "Pi", "Ps") or chr(c) in "\"'¿¡„"
        _upper.append(out)
    return _upper[0]


def sentences(text: V.Text) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of rough sentences: lines, cut after end marks that a sentence can follow.

    A point after a short capitalised word (Dr., Abb., J.) or before a digit after a short word (vol. 3) ends nothing.
    """
    cp, n = text.cp, len(text.cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = V.classes()[cp]
    lower = V.lower_table()[cp]
    space = (kind == V.SPACE) | (kind == V.BREAK)
    closer = _flags(cp, CLOSERS)
    mark = _flags(cp, ".!?。！？।…")
    # the place after the closing marks that follow each mark
    other = np.flatnonzero(~closer & ~mark)
    ends = np.flatnonzero(mark)
    ends = ends[~mark[np.minimum(ends + 1, n - 1)] | (ends == n - 1)]
    place = np.searchsorted(other, ends, "right")
    after = np.append(other, n)[place]
    solid = np.flatnonzero(~space)
    following = np.append(solid, n)[np.searchsorted(solid, after)]
    follow = cp[np.minimum(following, n - 1)]
    wide = _flags(cp[ends], "。！？।")
    spaced = following > after
    ok = _starts_sentence()[follow] | (following >= n)
    letters = kind == V.LETTER
    run_start, run_end = V.runs(letters.view(np.uint8), text.rows)
    run = np.searchsorted(run_start, np.maximum(ends - 1, 0), "right") - 1
    length = np.where(letters[np.maximum(ends - 1, 0)] & (ends > 0), run_end[run] - run_start[run], 99)
    capital = lower[run_start[run]] != cp[run_start[run]]
    dot = cp[ends] == ord(".")
    title = dot & (length <= 4) & capital & (length < 99)
    number = dot & (length <= 4) & (V.classes()[follow] == V.DIGIT)
    dots = dot & (ends > 0) & (cp[np.maximum(ends - 1, 0)] == ord("."))
    close = dot & (length >= 3) & (length < 99) & (lower[np.minimum(after, n - 1)] != cp[np.minimum(after, n - 1)])
    stop = wide & ok | (ok & (spaced | (following >= n)) & ~title & ~number) | (close & ~spaced & ~title)
    stop &= ~(dots & ~ok)
    cut = kind == V.BREAK
    cut = cut.copy()
    cut[after[stop] - 1] = True
    label = np.cumsum(cut)
    label[cut] -= 1
    row = np.searchsorted(text.rows, solid, "right")
    if not len(solid):
        return solid, solid
    new = np.flatnonzero(np.append(True, (np.diff(label[solid]) != 0) | (np.diff(row) != 0)))
    return solid[new], solid[np.append(new[1:] - 1, len(solid) - 1)] + 1


class Scorer:
    """Sums of word scores; remembers the scores of each distinct word."""

    def __init__(self, model: Model):
        self.model = model
        rng = np.random.default_rng(7)
        sign = rng.integers(0, 2, (FEATURES, PROJECTION)).astype(np.float32) * 2 - 1
        self.table = np.concatenate([model.centroids, sign * model.idf[:, None] / np.sqrt(PROJECTION)], axis=1).astype(np.float32)
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, self.table.shape[1]), np.float32)

    def words(self, text: V.Text, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each word, scores by code)."""
        low = V.lower_table()[text.cp]
        names = V.Spans(low).of(start, end)
        code, distinct = pd.factorize(names)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        scores = np.zeros((len(distinct), self.table.shape[1]), np.float32)
        scores[known] = self.rows[at[known]]
        if len(new):
            first = np.full(len(distinct), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            for k in range(0, len(new), WORDS_TOGETHER):
                some = new[k : k + WORDS_TOGETHER]
                scores[some] = self._of(low, start[first[some]], end[first[some]])
            if len(self.keys) + len(new) > KEEP:
                self.keys, self.rows = np.zeros(0, np.uint64), self.rows[:0]
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, scores[new]])[order]
        return code, scores

    def _of(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums over the n-grams of words, as ``_grams`` has them, gathered for all words at once."""
        kind = V.classes()[low[start]]
        edged = ~((kind == V.HAN) | (kind == V.KANA))
        size = end - start + 2 * edged
        at = np.append(0, np.cumsum(size))
        word = np.repeat(np.arange(len(start)), size)
        place = np.arange(at[-1])
        buffer = low[np.clip((start - at[:-1] - edged)[word] + place, 0, len(low) - 1)].copy()
        buffer[at[:-1][edged]] = 2
        buffer[at[1:][edged] - 1] = 3
        spans, left = V.Spans(buffer), at[1:][word] - place
        grams, owner = [], []
        for n in NGRAMS:
            some = np.flatnonzero((left >= n) & (edged[word] | (n <= 3)))
            grams.append((spans.of(some, some + n) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64))
            owner.append(word[some])
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        return np.add.reduceat(self.table[grams[order]], np.flatnonzero(np.append(True, np.diff(owner) != 0)), axis=0)

    def judge(self, sums: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language (-1: rejected), confidence and products by language for rows of sums over so many letters."""
        k, n = len(self.model.of), len(self.model.languages)
        norm = np.maximum(np.linalg.norm(sums[:, k:], axis=1), 1e-6)
        by = np.stack([sums[:, np.flatnonzero(self.model.of == j)].max(axis=1) for j in range(n)], axis=1) if n else np.zeros((len(sums), 1))
        best = by.argmax(axis=1)
        order = np.sort(by, axis=1)
        cosine = order[:, -1] / norm
        second = order[:, -2] if by.shape[1] > 1 else np.zeros(len(by))
        margin = np.where(order[:, -1] > 0, (order[:, -1] - second) / np.maximum(order[:, -1], 1e-9), 0)
        length = np.clip(np.searchsorted(LENGTHS, letters, "right") - 1, 0, len(LENGTHS) - 1)
        least = self.model.least[best, length] if n else np.ones(len(sums))
        least = least * np.minimum(1, letters / LENGTHS[0])  # less text comes less near
        ok = (cosine >= least) & (order[:, -1] > 0) & (n > 0)
        return np.where(ok, best, -1), np.where(ok, np.clip(np.sqrt(np.maximum(margin, 0)) * np.minimum(1, cosine / np.maximum(least, 1e-9)), 0, 1), 0.0), by


def _not_prose(text: V.Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Units that are no sentences: list items, table rows, code, menus, headings without an end mark."""
    cp = text.cp
    first = cp[start]
    last = cp[end - 1]
    listed = _flags(first, "*-+•|`#") | (_flags(first, "(") & _flags(cp[np.minimum(start + 1, len(cp) - 1)], "c") & _flags(cp[np.minimum(start + 2, len(cp) - 1)], ")"))
    fence = (first == ord("`")).astype(np.int64)
    row = text.row_of(start)
    seen = np.cumsum(fence)
    begin = np.searchsorted(row, row)
    inside = (seen - (seen[begin] - fence[begin])) % 2 == 1
    ended = _flags(last, ".!?。！？।…" + CLOSERS)
    number = (V.classes()[first] == V.DIGIT) & _flags(cp[np.minimum(start + 1, len(cp) - 1)], ".)") & (V.classes()[cp[np.minimum(start + 2, len(cp) - 1)]] == V.SPACE)
    return listed | inside | number | (~ended & (end - start <= HEADING))


_scorers: dict[int, Scorer] = {}
SEGMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("sentences", T.IntegerType())])
RESULT = T.StructType([T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("sentences", T.IntegerType()), T.StructField("segments", T.ArrayType(SEGMENT))])


def _detect(model: Model, scorer: Scorer, part: pa.Array) -> pa.Array:
    text = V.Text(part)
    n = len(text)
    start, end = sentences(text)
    ws, we = _words(text)
    empty = pa.array([None] * n, _arrow())
    if not len(ws) or not model.languages:
        return empty
    code, scores = scorer.words(text, ws, we)
    unit = np.searchsorted(start, ws, "right") - 1
    some, first = np.unique(unit, return_index=True)
    sums = np.stack([np.add.reduceat(column[code], first) for column in np.ascontiguousarray(scores.T)], axis=1)
    prose = ~_not_prose(text, start, end)[some]
    start, end = start[some], end[some]
    row = text.row_of(start)
    letters = np.add.reduceat(we - ws, first)
    lang, sure, _ = scorer.judge(sums, letters)
    rows, row_first = np.unique(row, return_index=True)
    row_last = np.append(row_first[1:], len(row))
    total, total_sure, _ = scorer.judge(np.add.reduceat(sums, row_first, axis=0), np.add.reduceat(letters, row_first))
    clear = sure >= np.where(end - start >= SHORT, CLEAR, SHORT_CLEAR)
    # texts of fewer than two sentences are judged as a whole; of the others, the sentences
    many = np.add.reduceat(prose, row_first)
    lone = many < 2
    use = np.flatnonzero(prose & ~np.repeat(lone, row_last - row_first))
    base = text.rows[row]
    # two rejected sentences in a row are in none of the languages; one alone goes with the one before
    rejected = lang[use] < 0
    together = np.append(False, row[use][1:] == row[use][:-1]) if len(use) else rejected
    run = rejected & ((np.append(False, rejected[:-1]) & together) | (np.append(rejected[1:], False) & np.append(together[1:], False))) if len(use) else rejected
    found: dict[int, list[list]] = {}
    names = model.languages
    now, at_row = -2, -1
    for k, r, this, sharp, none, first_place, last_place, s in zip(use.tolist(), row[use].tolist(), lang[use].tolist(), clear[use].tolist(), run.tolist(), (start[use] - base[use]).tolist(), (end[use] - base[use]).tolist(), sure[use].tolist(), strict=True):
        if r != at_row:
            now, at_row = -2, r
        if none:
            now = -2
            continue
        if not sharp and now >= 0:
            this = now
        if this < 0:
            continue
        if this == now:
            last = found[r][-1]
            last[1], last[3], last[4] = last_place, last[3] + s, last[4] + 1
        else:
            found.setdefault(r, []).append([first_place, last_place, names[this], s, 1])
            now = this
    out: list = [None] * n
    for r, a, b, whole, whole_sure, units, alone in zip(rows.tolist(), row_first.tolist(), row_last.tolist(), total.tolist(), total_sure.tolist(), many.tolist(), lone.tolist(), strict=True):
        if alone:
            segments = [[int(start[a] - text.rows[r]), int(end[b - 1] - text.rows[r]), names[whole], whole_sure, 1]] if whole >= 0 else []
        else:
            segments = found.get(r, [])
            for x in segments:
                x[3] /= x[4]
        if not segments:
            continue
        weight: dict[str, int] = {}
        for x in segments:
            weight[x[2]] = weight.get(x[2], 0) + x[1] - x[0]
        best = max(weight, key=lambda x: (weight[x], x))
        share = weight[best] / max(1, sum(weight.values()))
        out[r] = {"language": best, "confidence": float(share * max(x[3] for x in segments if x[2] == best)), "sentences": max(1, units), "segments": [dict(zip(("start", "end", "language", "confidence", "sentences"), x, strict=True)) for x in segments]}
    return pa.array(out, _arrow())


def _arrow():
    segment = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())])
    return pa.struct([("language", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("segments", pa.list_(segment))])


def fit_samples(samples: DataFrame, language: str = "language", text: str = "text", key: str = "sample_id") -> Model:
    """A model of at most FIT_ROWS labelled rows, those of the smallest keys."""
    rows = samples.select(key, language, text).distinct().orderBy(key, language, text).limit(FIT_ROWS).collect()
    return fit([(r[1], r[2]) for r in rows])


def detect_languages(df: DataFrame, samples: DataFrame, text: str = "text", into: str = "detected") -> DataFrame:
    """``df`` with a struct ``into``: language, confidence, sentences and segments (start, end, language, confidence, sentences).

    Segments are runs of sentences of one language; headings, lists, tables and code belong to none, nor do two or more
    sentences in a row that are far from every language.  A text of fewer than two sentences is one segment of one.  Null, empty and letterless texts, and texts far from every language,
    have a null struct.  Repeated rows get the same result; a column named ``into`` is replaced.
    """
    model = df.sparkSession.sparkContext.broadcast(fit_samples(samples))

    @F.arrow_udf(RESULT)
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hash((tuple(model.value.languages), float(model.value.centroids.sum())))
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(model.value)
        for batch in batches:
            parts = [_detect(model.value, _scorers[key], part) for _, part in V.slices(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _arrow())

    # not deterministic in name only: the optimizer must not run it once more for each use of the result
    return df.withColumn(into, detect.asNondeterministic()(F.col(text)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = detect_languages(spread(docs.select("doc_id", "lang", "text")), read_table(spark, sf_dir, "language_samples"))
    languages = (
        found.select("doc_id", "lang", F.col("detected.sentences").alias("n"), F.explode("detected.segments").alias("s"))
        .filter(((F.col("s.sentences") >= 2) | (F.col("n") < 2)) & ~F.col("s.language").eqNullSafe(language_code(F.col("lang"))))
        .select("doc_id", F.col("s.language").alias("language"))
        .distinct()
    )
    return languages.join(residue_documents(docs).select("doc_id"), "doc_id", "left_anti")


def p2_document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language beside its label's, and what the old detector said most lately of the whole document."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).dropDuplicates(["doc_id"])
    found = detect_languages(docs, read_table(spark, sf_dir, "language_samples")).select("doc_id", language_code(F.col("lang")).alias("label"), "detected.language", "detected.confidence", F.size("detected.segments").alias("n_segments"))
    old = read_table(spark, sf_dir, "language_detections").filter("section_seq is null").groupBy("doc_id").agg(F.max_by("language", F.struct("detected_at", "language")).alias("old_language"))
    return found.join(old, "doc_id", "left")
