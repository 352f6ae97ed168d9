"""Problem 8: passages of held-out test items inside a corpus.

Words of documents and items are hashes (lower case, look-alike letters as one).  A first
pass counts, over all documents, in how many each word and each three-word sequence of the
items occurs.  The rare sequences are seeds: a second pass looks them up in every document,
and where several seeds of one item fall close together, a Smith-Waterman alignment of the
item's words with that stretch of the document says which of the item's sentences are there.
Pairs are aligned in blocks, one array operation for a whole block.

The items are a fixed test suite (``MAX_ITEM_CHARACTERS`` at a time; larger ones are looked for in several runs); their words,
sequences and counts are what is broadcast.  Nothing of the documents is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import vector as V
from quire.llm.forms import CYRILLIC, GREEK, LATIN, script_tables
from quire.plans import read_table, spread

#: Characters of test items that are broadcast at a time.
MAX_ITEM_CHARACTERS = 10_000_000
GRAM = 3
#: A sequence is rare if at most this share of the documents has it; each sentence's ``KEEP`` rarest count anyway.
RARE_SHARE, KEEP = 0.005, 8
#: Seeds that must fall together before a stretch is aligned.
SEEDS = 3
MATCH, MISS, GAP = 2, -1, -1
#: Shares of a sentence's words, and of its rare words, that must be aligned with equal words.
WORDS_SHARE, RARE_WORDS_SHARE = 0.6, 0.35
BLOCK = 64


@lru_cache(1)
def _plain() -> np.ndarray:
    """Lower case and one script for look-alikes, by code point."""
    out = V.lower_table().copy()
    _, to = script_tables()
    latin = np.arange(0x110000, dtype=np.uint32)
    latin[:0x530] = to[LATIN]
    return latin[out]


def words_of(text: V.Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the row of each; ideographs and kana are words by themselves."""
    cp = _plain()[text.cp]
    kind = V.classes()[text.cp]
    start, end = V.runs(np.where(kind == V.DIGIT, V.LETTER, kind), text.rows)
    first = kind[start] if len(start) else kind
    wide = (first == V.HAN) | (first == V.KANA)
    word = (first == V.LETTER) | (first == V.DIGIT)
    s, e = start[word], end[word]
    if wide.any():
        a, b = start[wide], end[wide]
        each = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        s, e = np.concatenate([s, each]), np.concatenate([e, each + 1])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
    return V.Spans(cp).of(s, e), text.row_of(s)


def grams_of(words: np.ndarray) -> np.ndarray:
    """The hash of each sequence of GRAM words, by its first word."""
    if len(words) < GRAM:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - GRAM + 1].copy()
    for k in range(1, GRAM):
        out = V.mix(out * np.uint64(0xD1342543DE82EF95) + words[k : len(words) - GRAM + 1 + k])
    return out


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    sentence: list[np.ndarray]  # the sentence of each word
    unigrams: np.ndarray  # distinct, sorted
    grams: np.ndarray


def passage(text: str | None) -> str:
    """The passage of an item: without the instruction line, if the item has several lines."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return "\n".join(lines[1:]) if len(lines) > 1 else "".join(lines)


def sentences_of(text: str) -> list[str]:
    out: list[str] = []
    for part in re.split(r"(?<=[.!?。！？।])\s+|(?<=[。！？])", text):
        if out and len(words_of(V.Text(pa.array([part], pa.large_string())))[0]) < 4:
            out[-1] += " " + part
        elif part:
            out.append(part)
    return out


def prepare(rows: list[tuple[object, str | None]]) -> Items:
    ids, words, sentence = [], [], []
    for key, text in rows:
        parts = sentences_of(passage(text))
        got = [words_of(V.Text(pa.array([p], pa.large_string())))[0] for p in parts]
        if key is None or not any(map(len, got)):
            continue
        ids.append(key)
        words.append(np.concatenate(got))
        sentence.append(np.repeat(np.arange(len(got)), [len(x) for x in got]))
    none = np.zeros(0, np.uint64)
    return Items(ids, words, sentence, np.unique(np.concatenate([none, *words])), np.unique(np.concatenate([none, *map(grams_of, words)])))


def _places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    if not len(table) or not len(values):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def _row_grams(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that lie within one row, and the place of their first word."""
    grams = grams_of(words)
    inside = np.flatnonzero(row[: len(grams)] == row[GRAM - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    return grams[inside], inside


def _hit(filter_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of the values that may be in the table behind a bit filter."""
    return np.flatnonzero(filter_[(values >> np.uint64(44)).astype(np.int64)])


def _filter(table: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(table >> np.uint64(44)).astype(np.int64)] = True
    return out


def document_counts(docs: DataFrame, text: str, items) -> DataFrame:
    """(kind, place, n): in how many documents each word (0) and sequence (1) of the items occurs, and the documents (2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        tables = (known.unigrams, known.grams)
        filters = [_filter(t) for t in tables]
        total = [np.zeros(len(t), np.int64) for t in tables]
        docs_seen = 0
        for batch in batches:
            docs_seen += batch.num_rows
            for _, part in V.slices(batch.column(0)):
                t = V.Text(part)
                words, row = words_of(t)
                grams, at = _row_grams(words, row)
                for k, (values, rows) in enumerate(((words, row), (grams, row[at]))):
                    some = _hit(filters[k], values)
                    place = _places(tables[k], values[some])
                    some, place = some[place >= 0], place[place >= 0]
                    pairs = np.unique(rows[some].astype(np.int64) * len(tables[k]) + place)
                    total[k] += np.bincount(pairs % max(1, len(tables[k])), minlength=len(tables[k]))
        kinds = np.concatenate([np.full(np.count_nonzero(x), k) for k, x in enumerate(total)] + [[2]])
        places = np.concatenate([np.flatnonzero(x) for x in total] + [[0]])
        numbers = np.concatenate([x[x > 0] for x in total] + [[docs_seen]])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array(numbers, pa.int64())], ["kind", "place", "n"])

    return docs.select(text).mapInArrow(count, "kind int, place bigint, n bigint").groupBy("kind", "place").agg(F.sum("n").alias("n"))


def align(doc: np.ndarray, doc_len: np.ndarray, item: np.ndarray, item_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of a block: doc (B, L) with item (B, M); best scores, and which item words meet an equal word."""
    b, width = doc.shape
    depth = item.shape[1]
    step = np.arange(width + 1, dtype=np.int32)
    above = np.zeros((b, width + 1), np.int32)
    move = np.zeros((depth, b, width + 1), np.int8)  # 1 diagonal, 2 up, 3 left
    best, best_i, best_j = np.zeros(b, np.int32), np.zeros(b, np.int64), np.zeros(b, np.int64)
    inside = step[None, 1:] <= doc_len[:, None]
    for i in range(depth):
        equal = doc == item[:, i : i + 1]
        diagonal = above[:, :-1] + np.where(equal, MATCH, MISS).astype(np.int32)
        up = above[:, 1:] + GAP
        now = np.zeros((b, width + 1), np.int32)
        np.maximum(diagonal, up, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        filled = np.maximum.accumulate(now - GAP * step, axis=1) + GAP * step
        kind = np.zeros((b, width + 1), np.int8)
        kind[:, 1:] = np.where(diagonal >= up, 1, 2)
        kind[filled > now] = 3
        kind[filled <= 0] = 0
        valid = inside & (i < item_len)[:, None]
        filled[:, 1:] *= valid
        move[i] = kind
        j = filled.argmax(axis=1)
        value = filled[np.arange(b), j]
        more = value > best
        best[more], best_i[more], best_j[more] = value[more], i, j[more]
        above = filled
    met = np.zeros((b, depth), bool)
    alive = np.flatnonzero(best > 0)
    i, j = best_i.copy(), best_j.copy()
    while len(alive):
        kind = move[i[alive], alive, j[alive]]
        diagonal = alive[kind == 1]
        met[diagonal, i[diagonal]] = doc[diagonal, j[diagonal] - 1] == item[diagonal, i[diagonal]]
        i[alive[(kind == 1) | (kind == 2)]] -= 1
        j[alive[(kind == 1) | (kind == 3)]] -= 1
        alive = alive[(kind > 0) & (i[alive] >= 0) & (j[alive] > 0)]
    return best, met


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item key, doc key, n_sentences, score): documents that hold two or more consecutive sentences of an item.

    Null or empty texts on either side yield nothing; repeated rows yield one result; an item of one
    sentence cannot leak.  Every document is read whole, twice (counts, then seeds); only pairs that pass
    the seeds are aligned.
    """
    docs = spread(docs.select(F.col(doc_key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null"))
    rows = items.select(F.col(item_key).cast("bigint"), F.col(item_text)).distinct().collect()  # a fixed test suite
    # what is broadcast is bounded: more items than that are looked for in as many runs as they need
    runs, size = [[]], 0
    for r in sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0], r[1] or "")):
        size += len(r[1] or "")
        if size > MAX_ITEM_CHARACTERS and runs[-1]:
            runs.append([])
            size = len(r[1] or "")
        runs[-1].append(r)
    found = [_leaks(docs, run, item_key, doc_key) for run in runs]
    return reduce(DataFrame.unionByName, found)


def _leaks(docs: DataFrame, rows: list[tuple], item_key: str, doc_key: str) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    known = prepare(rows)
    shared = sc.broadcast(known)
    n_docs, seen, gram_seen = 0, np.zeros(len(known.unigrams), np.int64), np.zeros(len(known.grams), np.int64)
    if known.ids:
        for kind, place, n in document_counts(docs, "t", shared).collect():  # at most one row for each word and sequence of the items
            if kind == 2:
                n_docs = n
            else:
                (seen, gram_seen)[kind][place] = n
    limit = max(2.0, RARE_SHARE * n_docs)
    # seeds: (gram hash, item, place of its first word)
    seed_gram, seed_item, seed_at, rare = [], [], [], []
    for k, words in enumerate(known.words):
        rare.append(seen[_places(known.unigrams, words)] <= limit)
        grams = grams_of(words)
        if not len(grams):
            continue
        n = gram_seen[_places(known.grams, grams)]
        chosen = n <= limit
        in_sentence = known.sentence[k][: len(grams)]
        for s in np.unique(in_sentence):
            mine = np.flatnonzero(in_sentence == s)
            chosen[mine[np.argsort(n[mine], kind="stable")[:KEEP]]] = True
        at = np.flatnonzero(chosen)
        seed_gram.append(grams[at])
        seed_item.append(np.full(len(at), k))
        seed_at.append(at)
    none = np.zeros(0, np.int64)
    seed_gram = np.concatenate([np.zeros(0, np.uint64), *seed_gram])
    order = np.argsort(seed_gram, kind="stable")
    seeds = sc.broadcast((seed_gram[order], np.concatenate([none, *seed_item])[order], np.concatenate([none, *seed_at])[order], rare))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (table, of_item, of_place, rare) = shared.value, seeds.value
        table, group = np.unique(table, return_index=True)
        group = np.append(group, len(of_item))
        bits = _filter(table)
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for first, part in V.slices(batch.column(1)):
                words, row = words_of(V.Text(part))
                found = _search(known, table, group, of_item, bits, rare, words, row)
                if found:
                    item, r, n, score = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([known.ids[i] for i in item], pa.int64()), pa.array(keys[first + np.asarray(r)], pa.int64()), pa.array(n, pa.int32()), pa.array(score, pa.int32())],
                        ["item", "doc", "n_sentences", "score"],
                    )

    out = docs.mapInArrow(search, "item bigint, doc bigint, n_sentences int, score int")
    return out.groupBy(F.col("item").alias(item_key), F.col("doc").alias(doc_key)).agg(F.max("n_sentences").alias("n_sentences"), F.max("score").alias("score"))


def _search(known: Items, table, group, of_item, bits, rare, words, row) -> list[tuple[int, int, int, int]]:
    grams, at = _row_grams(words, row)
    some = _hit(bits, grams)
    place = _places(table, grams[some])
    some, place = some[place >= 0], place[place >= 0]
    if not len(some):
        return []
    size = group[place + 1] - group[place]
    where = np.repeat(at[some], size)
    item = of_item[np.repeat(group[place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    order = np.lexsort((where, item, row[where]))
    where, item = where[order], item[order]
    long = np.array([len(w) for w in known.words])
    cut = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (np.diff(row[where]) != 0) | (np.diff(where) > long[item[1:]])))
    size = np.diff(np.append(cut, len(item)))
    starts = np.searchsorted(row, np.arange(row[-1] + 2))
    jobs = []
    for c, n in zip(cut[size >= SEEDS], size[size >= SEEDS], strict=True):
        k, r, a, b = item[c], row[where[c]], where[c], where[c + n - 1]
        first, last, reach = max(starts[r], a - long[k]), min(starts[r + 1], b + long[k] + GRAM), 2 * (long[k] + GRAM)
        # a chain of seeds of any length is aligned in stretches that overlap by twice the item
        jobs += [(k, r, x, min(x + 2 * reach, last)) for x in range(first, max(first + 1, last - reach), reach)]
    jobs.sort(key=lambda j: j[3] - j[2])
    found = []
    for low in range(0, len(jobs), BLOCK):
        block = jobs[low : low + BLOCK]
        width, depth = max(j[3] - j[2] for j in block), max(long[j[0]] for j in block)
        doc, itm = np.zeros((len(block), width), np.uint64), np.ones((len(block), depth), np.uint64)
        for x, (k, _, a, b) in enumerate(block):
            doc[x, : b - a] = words[a:b]
            itm[x, : long[k]] = known.words[k]
        score, met = align(doc, np.array([j[3] - j[2] for j in block]), itm, np.array([long[j[0]] for j in block]))
        for x, (k, r, _, _) in enumerate(block):
            n = consecutive(met[x, : long[k]], known.sentence[k], rare[k])
            if n >= 2:
                found.append((int(k), int(r), n, int(score[x])))
    return found


def consecutive(met: np.ndarray, sentence: np.ndarray, rare: np.ndarray) -> int:
    """The most consecutive sentences of which enough words, and enough rare words, are met."""
    n = int(sentence[-1]) + 1
    size, hits = np.bincount(sentence, minlength=n), np.bincount(sentence, met, n)
    rare_size, rare_hits = np.bincount(sentence, rare, n), np.bincount(sentence, met & rare, n)
    there = (hits >= WORDS_SHARE * size) & (rare_hits >= RARE_WORDS_SHARE * rare_size)
    best = now = 0
    for x in there:
        now = now + 1 if x else 0
        best = max(best, now)
    return best


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return leaks.select("item_id", "doc_id")
