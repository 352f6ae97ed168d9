"""Problem 1: token numbers that can be trusted, and totals by source, format, language and domain.

A vocabulary of scored pieces is held in a double-array trie.  Each text is cut into
segments (runs of one kind of character, with a single leading space); the segments of
a batch are named by hashes, and only those not met before are scored: a count-only
Viterbi pass over all of them in lockstep finds the path of best score and keeps its
length, not the path.  A document's number is the sum over its segments.

The scores of a rank file follow Zipf's law: the piece of rank k gets -log(k + 3) less
the log of the normalising sum, as a unigram vocabulary would give it.
"""

from __future__ import annotations

import base64
import math
import os
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import vector as V
from quire.plans import read_table, spread, staged

TOKENIZERS = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Segments remembered by a worker before it starts afresh.
KEEP = 400_000
#: Bytes of a segment from which its path is found by itself, and places that segments in lockstep hold together.
LONG, CELLS = 4096, 1 << 22


class DoubleArray:
    """A trie over byte strings as three arrays.  From state s, byte b leads to base[s] + b + 1 if check there is s."""

    def __init__(self, pieces: dict[bytes, float]):
        order = sorted(pieces)
        nodes: list[tuple[int, int, int, int]] = [(0, len(order), 0, 0)]  # first, last, depth, state
        size = max(1024, 4 * sum(map(len, order)) // 3 + 1024)
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.score = np.full(size, -np.inf, np.float32)
        used = bytearray(size)
        used[0] = 1
        self.check[0] = 0
        self.depth = max(map(len, order), default=0)
        self._lists: tuple[list, list, list] | None = None
        free = 1
        while nodes:
            first, last, depth, state = nodes.pop()
            if first < last and len(order[first]) == depth:
                self.score[state] = pieces[order[first]]
                first += 1
            if first == last:
                continue
            groups, i = [], first
            while i < last:
                b, j = order[i][depth], i
                while j < last and order[j][depth] == b:
                    j += 1
                groups.append((b, i, j))
                i = j
            low = groups[0][0] + 1
            base = max(0, free - low)
            while True:
                if base + 257 >= len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    self.base = np.concatenate([self.base, np.zeros(grow, np.int32)])
                    self.check = np.concatenate([self.check, np.full(grow, -1, np.int32)])
                    self.score = np.concatenate([self.score, np.full(grow, -np.inf, np.float32)])
                if not any(used[base + b + 1] for b, _, _ in groups):
                    break
                at = used.find(0, base + low + 1)
                base = (at if at >= 0 else len(used)) - low
            self.base[state] = base
            for b, i, j in groups:
                to = base + b + 1
                used[to] = 1
                self.check[to] = state
                nodes.append((i, j, depth + 1, to))
            if len(groups) > 1 or free < base:
                free = used.find(0, free)
                free = free if free >= 0 else len(used)
        last = len(used.rstrip(b"\0")) + 258
        self.base, self.check, self.score = (np.concatenate([x, np.full(max(0, last - len(x)), y, x.dtype)])[:last] for x, y in ((self.base, 0), (self.check, -1), (self.score, -np.inf)))

    def counts(self, segments: list[bytes]) -> np.ndarray:
        """The number of pieces on each segment's path of best score, all segments in lockstep."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        out = np.zeros(len(segments), np.int64)
        order = np.argsort(size, kind="stable")
        low, short = 0, int(np.searchsorted(size[order], LONG, "right"))
        while low < short:
            high = min(low + 20_000, short)
            while (high - low) * int(size[order[high - 1]]) > CELLS and high > low + 1:
                high = low + max(1, (high - low) // 2)
            mine = order[low:high]
            out[mine] = self._lockstep([segments[i] for i in mine], size[mine])
            low = high
        for i in order[short:]:
            out[i] = self._alone(segments[i])
        return out

    def _alone(self, s: bytes) -> int:
        """The number of pieces on the best path of one segment of any length; only the last places are kept."""
        if self._lists is None:
            self._lists = self.base.tolist(), self.check.tolist(), self.score.tolist()
        base, check, score = self._lists
        n, depth, none = len(s), self.depth, -math.inf
        ahead = deque([(0.0, 0)] + [(none, 0)] * depth)  # the best score and its pieces at this place and the next ones
        for i in range(n):
            here, many = ahead.popleft()
            ahead.append((none, 0))
            if here == none:
                continue
            state = 0
            for k in range(i, min(n, i + depth)):
                to = base[state] + s[k] + 1
                if check[to] != state:
                    break
                state = to
                total = here + score[state]
                if total > ahead[k - i][0]:
                    ahead[k - i] = (total, many + 1)
        return ahead[0][1] if ahead[0][0] > none else n

    def _lockstep(self, parts: list[bytes], size: np.ndarray) -> np.ndarray:
        n, width = len(parts), int(size.max()) if len(parts) else 0
        text = np.zeros((width, n), np.uint8)
        for k, s in enumerate(parts):
            text[: len(s), k] = np.frombuffer(s, np.uint8)
        best = np.full((width + 1, n), -np.inf, np.float32)
        many = np.zeros((width + 1, n), np.int32)
        best[0] = 0
        for i in range(width):
            rows = np.flatnonzero((size > i) & (best[i] > -np.inf))
            state = np.zeros(len(rows), np.int32)
            for k in range(i, min(width, i + self.depth)):
                to = self.base[state] + text[k, rows] + 1
                ok = (self.check[to] == state) & (size[rows] > k)
                if not ok.all():
                    rows, to = rows[ok], to[ok]
                if not len(rows):
                    break
                state = to
                score = best[i, rows] + self.score[state]
                better = score > best[k + 1, rows]
                if better.any():
                    r = rows[better]
                    best[k + 1, r] = score[better]
                    many[k + 1, r] = many[i, r] + 1
        got = many[size, np.arange(n)]
        return np.where(best[size, np.arange(n)] > -np.inf, got, size)


def rank_file(path: str) -> dict[bytes, float]:
    """Pieces of a rank file with Zipf scores; single bytes that it lacks come last, so every text has a path."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    top = max(ranks.values(), default=0)
    for b in range(256):
        ranks.setdefault(bytes([b]), top + 1 + b)
    total = math.log(sum(1 / (k + 3) for k in ranks.values()))
    return {piece: -math.log(k + 3) - total for piece, k in ranks.items()}


@lru_cache(4)
def load_trie(name: str = VOCABULARY, folder: str = TOKENIZERS) -> DoubleArray:
    return DoubleArray(rank_file(os.path.join(folder, name)))


class Counter:
    """Token numbers of texts; remembers the count of each distinct segment."""

    def __init__(self, trie: DoubleArray):
        self.trie = trie
        self.keys = np.zeros(0, np.uint64)
        self.vals = np.zeros(0, np.int64)

    def _merge(self, keys: np.ndarray, vals: np.ndarray) -> None:
        if len(self.keys) + len(keys) > KEEP:
            self.keys, self.vals = keys, vals
        else:
            keys = np.concatenate([self.keys, keys])
            order = np.argsort(keys, kind="stable")
            self.keys, self.vals = keys[order], np.concatenate([self.vals, vals])[order]

    def numbers(self, array: pa.Array) -> np.ndarray:
        out = [self._slice(V.Text(part)) for _, part in V.slices(array)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _slice(self, text: V.Text) -> np.ndarray:
        n = len(text)
        if not len(text.cp):
            return np.zeros(n, np.int64)
        start, end = segments(text)
        names = V.Spans(text.cp).of(start, end)
        import pandas as pd

        code, distinct = pd.factorize(names)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        value = np.zeros(len(distinct), np.int64)
        value[known] = self.vals[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.full(len(distinct), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            value[new] = self.trie.counts([unicodedata.normalize("NFC", text.string(start[k], end[k])).encode() for k in first[new]])
            order = np.argsort(distinct[new])
            self._merge(distinct[new][order], value[new][order])
        return np.bincount(text.row_of(start), weights=value[code], minlength=n).astype(np.int64)


def segments(text: V.Text) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one kind of character; the last space before another run belongs to that run."""
    kind = V.classes()[text.cp]
    start, end = V.runs(kind, text.rows)
    space = np.flatnonzero((kind[start] == V.SPACE))
    space = space[space + 1 < len(start)]
    follow = np.ones(len(space), bool)
    heads = np.zeros(len(kind) + 1, bool)
    heads[text.rows] = True
    follow &= ~heads[end[space]]
    follow &= kind[np.minimum(end[space], len(kind) - 1)] != V.BREAK
    space = space[follow]
    start[space + 1] -= 1
    end[space] -= 1
    keep = end > start
    return start[keep], end[keep]


_counters: dict[tuple[str, str], Counter] = {}


def _counter(name: str, folder: str, trie) -> Counter:
    if (name, folder) not in _counters:
        _counters[name, folder] = Counter(trie.value)
    return _counters[name, folder]


def count_tokens(df: DataFrame, text: str, into: str = "n_tokens", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in the column ``into``.

    Null text has a null number, empty text 0.  Repeated rows keep their number each.  A column
    already named ``into`` is replaced.  No shuffle: the trie (a few MB, fixed by the vocabulary)
    is broadcast.
    """
    trie = df.sparkSession.sparkContext.broadcast(load_trie(vocabulary, folder))

    @F.arrow_udf("bigint")
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(vocabulary, folder, trie)
        for batch in batches:
            yield pa.array(counter.numbers(batch), pa.int64(), mask=~np.asarray(batch.is_valid()))

    return df.withColumn(into, number(F.col(text)))


def script_of(text) -> "F.Column":
    """The script that decides how many tokens a character takes."""
    t = F.col(text) if isinstance(text, str) else text
    return (
        F.when(t.rlike("[ぁ-ヿ]"), "kana")
        .when(t.rlike("[一-鿿]"), "han")
        .when(t.rlike("[ऀ-ॿ]"), "deva")
        .when(t.rlike("[а-я]{2}"), "cyrl")
        .otherwise("latn")
    )


def judged_chunks(chunks: DataFrame, limit: float = 3.0, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """chunk_key, doc_id, token_count, n_tokens, trusted: the stored number beside the computed one.

    The stored numbers come from another vocabulary (cl100k_base).  Most of them are right, so the
    median ratio of stored to computed number by script, over all rows, turns the one scale into the
    other; ``trusted`` is whether the stored number lies within ``limit`` times of that.  Null or
    non-positive numbers are never trusted; a null content gives null n_tokens and an untrusted row.
    Repeated rows appear once.  The computed table (four numbers a row) is staged, as both the
    medians and the judgement read it.
    """
    df = spread(chunks.select("chunk_key", "doc_id", "token_count", "content"))
    df = df.withColumn("script", script_of("content"))
    df = count_tokens(df, "content", vocabulary=vocabulary, folder=folder).drop("content")
    df = staged(df, "chunk-tokens").dropDuplicates(["chunk_key", "token_count", "n_tokens"])
    scale = (
        df.filter((F.col("token_count") > 0) & (F.col("n_tokens") > 0))
        .groupBy("script")
        .agg(F.percentile_approx(F.col("token_count") / F.col("n_tokens"), 0.5, 1000).alias("scale"))
    )
    df = df.join(F.broadcast(scale), "script", "left")  # five scripts
    expected = F.col("n_tokens") * F.coalesce("scale", F.lit(1.0))
    wrong = F.col("token_count").isNull() | (F.col("token_count") <= 0) | F.col("n_tokens").isNull()
    wrong = wrong | (F.col("token_count") > limit * expected) | (F.col("token_count") * limit < expected)
    return df.select("chunk_key", "doc_id", "token_count", "n_tokens", F.floor(expected + 0.5).alias("n_expected"), (~F.coalesce(wrong, F.lit(True))).alias("trusted"))


#: Names of languages, by code, as labels spell them (fixed values).
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"),
    "pt": ("pt", "por", "portuguese", "português"),
    "es": ("es", "spa", "spanish", "español"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "ru": ("ru", "rus", "russian", "русский"),
    "ja": ("ja", "jpn", "japanese", "日本語"),
    "zh": ("zh", "zho", "chi", "chinese", "中文"),
    "hi": ("hi", "hin", "hindi", "हिन्दी"),
}


def language_code(label):
    """The code that a label names in any spelling, with or without a region; null where it names none."""
    names = {n: code for code, all_ in LANGUAGE_NAMES.items() for n in all_}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(F.trim(label), r"^([^-_]*)", 1)))


def format_code(label):
    """One spelling of a source format: no dot, lower case, htm as html."""
    plain = F.lower(F.regexp_replace(F.trim(label), r"^\.", ""))
    return F.when(plain == "htm", "html").otherwise(plain)


def newest(df: DataFrame, key: str, stamp: str, *columns: str) -> DataFrame:
    """The row of greatest ``stamp`` for each key (ties: the greatest values); one shuffle, combined map-side."""
    row = F.max(F.struct(F.col(stamp), *[F.col(c) for c in columns])).alias("_row")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def token_budget(documents: DataFrame, metadata: DataFrame, chunks: DataFrame, **how) -> DataFrame:
    """Documents, chunks and their tokens by source, source_format, language and domain.

    The language is the newest label's code ("und" where it names none) and null slices keep null.
    Chunk numbers are summed by document before the join, so a document that owns a tenth of the
    chunks sends one row for each map task.
    """
    docs = count_tokens(spread(documents.select("doc_id", "source", "domain", "text")), "text", "n_doc", **how).drop("text")
    labels = newest(metadata, "doc_id", "updated_at", "language", "source_format")
    per_doc = judged_chunks(chunks, **how).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_tokens").alias("chunk_tokens"))
    return (
        docs.dropDuplicates(["doc_id"])
        .join(labels, "doc_id", "left")
        .join(per_doc, "doc_id", "left")
        .groupBy("source", format_code(F.col("source_format")).alias("source_format"), F.coalesce(language_code(F.col("language")), F.lit("und")).alias("language"), "domain")
        .agg(
            F.count("*").alias("n_documents"),
            F.sum("n_doc").alias("document_tokens"),
            F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"),
            F.coalesce(F.sum("chunk_tokens"), F.lit(0)).alias("chunk_tokens"),
        )
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_chunks(read_table(spark, sf_dir, "chunks")).filter("not trusted").select("chunk_key").distinct()


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_budget(*(read_table(spark, sf_dir, t) for t in ("documents", "document_metadata", "chunks")))
