"""Problem 5: items larger than their preset allows, cut at natural boundaries with an overlap.

All places where an item may be cut (ends of paragraphs, sentences, clauses, words; every character
inside a stretch without any) are nodes.  Each node is joined to its farthest legal successor: the
farthest place of the strongest kind that a piece starting there, its overlap included, may reach.
Squaring the successor table doubles the distance it jumps; the cuts reached so far, jumped once by
each power, give all greedy cuts of all items of a batch in a number of steps logarithmic in the
largest number of pieces.

A piece's size is ceil(characters / 4), as TESTDATA.md measures it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import vector as V
from quire.llm.language import sentences
from quire.plans import read_table, spread

CHARS = 4  # characters that make a token of size
# kinds of boundary, from the strongest
PARAGRAPH, SENTENCE, CLAUSE, WORD, ANY = range(5)
PIECE = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "fresh", "end")]))


def boundaries(text: V.Text) -> tuple[np.ndarray, np.ndarray]:
    """Places where text may be cut, rows' ends included, and the kind of each.

    Between lines of a list, a table or fenced code lies only a boundary of the kind CLAUSE, so that
    structures stay whole where they can.
    """
    cp, n = text.cp, len(text.cp)
    kind = np.full(n + 1, ANY + 1, np.int8)
    cls = V.classes()[cp]
    space = (cls == V.SPACE) | (cls == V.BREAK)
    after = np.flatnonzero(space[:-1] & ~space[1:]) + 1 if n else np.zeros(0, np.int64)
    kind[after] = WORD
    wide = np.flatnonzero((cls == V.HAN) | (cls == V.KANA))
    kind[wide] = np.minimum(kind[wide], WORD)
    pause = np.isin(cp, np.array([ord(c) for c in ",;:，、；："], np.uint32))
    at = np.flatnonzero(pause) + 1
    at = at[at < n]
    at = np.where(space[at], _skip(space, at), at)
    kind[at] = CLAUSE
    start, _ = sentences(text)
    kind[start] = SENTENCE
    line = np.zeros(n + 1, np.int64)
    np.cumsum(cp == 10, out=line[1:])
    solid = np.flatnonzero(~space)
    if len(solid):
        breaks = np.append(0, line[solid[1:]] - line[solid[:-1]])
        first = solid[np.append(True, breaks[1:] > 0)]  # of each line
        kind[first] = np.minimum(kind[first], SENTENCE)
        lead = cp[first]
        plain = np.isin(lead, np.array([ord(c) for c in "|*-+•"], np.uint32))
        fence = (lead == ord("`")).astype(np.int64)
        row = np.searchsorted(text.rows, first, "right")
        seen = np.cumsum(fence)
        begin = np.searchsorted(row, row)
        inside = (seen - (seen[begin] - fence[begin])) % 2 == 1
        structured = plain | inside & ~((fence > 0) & inside)
        closing = (fence > 0) & ~inside
        joined = (structured & np.append(False, structured[:-1] | inside[:-1])) | closing | (inside & ~(fence > 0))
        kind[first[joined]] = CLAUSE
        kind[solid[breaks >= 2]] = np.minimum(kind[solid[breaks >= 2]], np.where(kind[solid[breaks >= 2]] == CLAUSE, CLAUSE, PARAGRAPH))
    kind[text.rows] = PARAGRAPH
    place = np.flatnonzero(kind <= WORD)
    return place, kind[place]


def _skip(space: np.ndarray, at: np.ndarray) -> np.ndarray:
    solid = np.append(np.flatnonzero(~space), len(space))
    return np.minimum(solid[np.searchsorted(solid, at)], len(space))


def cut(text: V.Text, most: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, fresh, end) of the pieces of every row, in characters of the whole array.

    ``most`` and ``overlap`` are characters by row.  A piece is [start, end); what it does not share with the
    piece before starts at ``fresh``.  An overlap over half the limit counts as half.
    """
    overlap = np.minimum(overlap, most // 2)
    place, kind = boundaries(text)
    n_rows = len(text)
    # every character is a place inside stretches that no piece can span
    row_of_gap = np.minimum(np.searchsorted(text.rows, place[:-1], "right") - 1, max(n_rows - 1, 0))
    room = np.maximum(1, most - overlap)[row_of_gap] if n_rows else row_of_gap
    wide = np.flatnonzero(np.diff(place) > room)
    if len(wide):
        size = place[wide + 1] - place[wide] - 1
        extra = np.repeat(place[wide] + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = np.concatenate([place, extra])
        kind = np.concatenate([kind, np.full(len(extra), ANY, kind.dtype)])
        order = np.argsort(place, kind="stable")
        place, kind = place[order], kind[order]
    row = np.searchsorted(text.rows, place, "right") - 1  # of the text that begins or goes on here
    row = np.minimum(row, max(n_rows - 1, 0))
    begin, finish = text.rows[row], text.rows[row + 1]
    # where a piece with fresh text from here starts: the first place within the overlap
    back = np.maximum(begin, place - overlap[row])
    shared = place[np.minimum(np.searchsorted(place, back), len(place) - 1)]
    start = np.where((place > begin) & (overlap[row] > 0), np.where(shared < place, shared, back), place)
    start = np.where(place == begin, place, start)
    limit = np.minimum(start + most[row], finish)
    step = np.arange(len(place))
    next_ = np.full(len(place), -1, np.int64)
    for strongest in (PARAGRAPH, SENTENCE, CLAUSE, WORD, ANY):
        mine = np.flatnonzero(kind <= strongest)
        far = mine[np.maximum(np.searchsorted(place[mine], limit, "right") - 1, 0)]
        # a boundary counts if the piece it ends is at least half full, or it is the last resort
        good = (place[far] > place) & ((place[far] - start >= most[row] // 2) | (place[far] == finish) | (strongest == ANY))
        next_ = np.where((next_ < 0) & good, far, next_)
    fallback = np.minimum(np.searchsorted(place, limit, "right") - 1, len(place) - 1)
    next_ = np.where(next_ < 0, np.maximum(fallback, step), next_)
    last = np.searchsorted(place, text.rows[1:])
    roots = np.searchsorted(place, text.rows[:-1])[np.diff(text.rows) > 0]
    reached = np.zeros(len(place), bool)
    of_row = np.full(len(place), -1, np.int64)
    reached[roots], of_row[roots] = True, row[roots]
    is_end = np.zeros(len(place), bool)
    is_end[last] = True
    jump = np.where(is_end[next_], step, next_)  # stop before a row's end, which may be the next row's start
    while True:
        at = np.flatnonzero(reached)
        to = jump[at]
        new = ~reached[to]
        if not new.any():
            break
        reached[to] = True
        jump = jump[jump]
    at = np.flatnonzero(reached & (begin < finish))
    return row[at], start[at], place[at], place[next_[at]]


def pieces(df: DataFrame, text: str, most: str, overlap: str, into: str = "pieces") -> DataFrame:
    """``df`` with an array of (start, fresh, end) of the pieces of ``text``, in characters.

    ``most`` and ``overlap`` name columns of tokens.  Null text or a null or non-positive limit gives a null
    array; text within its limit is one piece, empty text none.  A null overlap is none; an overlap over half
    the limit counts as half.  Only oversized texts go to Python; nothing is shuffled.
    """

    @F.arrow_udf(PIECE)
    def find(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, limits, overlaps in batches:
            out = []
            for first, part in V.slices(texts):
                t = V.Text(part)
                limit = np.asarray(limits.slice(first, len(part)).fill_null(1), np.int64) * CHARS
                shared = np.asarray(overlaps.slice(first, len(part)).fill_null(0), np.int64) * CHARS
                row, start, fresh, end = cut(t, limit, shared)
                at = np.zeros(len(part) + 1, np.int32)
                np.cumsum(np.bincount(row, minlength=len(part)), out=at[1:])
                base = t.rows[row]
                values = pa.StructArray.from_arrays([pa.array(x - base, pa.int32()) for x in (start, fresh, end)], ["start", "fresh", "end"])
                out.append(pa.ListArray.from_arrays(pa.array(at), values))
            kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "fresh", "end")]))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    large = F.ceil(F.length(text) / CHARS) > F.col(most)
    known = F.col(text).isNotNull() & (F.col(most) > 0)
    whole = F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("fresh"), F.length(text).alias("end")))).otherwise(F.array().cast(PIECE))
    base = df.withColumn(into, F.when(known, whole).cast(PIECE))
    fits = base.filter(~F.coalesce(known & large, F.lit(False)))
    over = df.filter(known & large).withColumn(into, find(F.col(text), F.col(most).cast("int"), F.coalesce(F.col(overlap), F.lit(0)).cast("int")))
    return fits.unionByName(over)


def split_items(items: DataFrame, options: DataFrame, kind: str, key: str, text: str = "content") -> DataFrame:
    """(item_kind, item_key, piece, pieces, start, fresh, end, size, overlap, content) of every item by its preset.

    Items of a null or unknown preset, or of null content, have no limit and give nothing.  Repeated rows give
    repeated pieces.  ``options`` holds one row for each preset (of several, the smallest limit) and is broadcast
    after that reduction, as the number of presets is fixed by the configuration.
    """
    limits = options.groupBy("preset").agg(F.min("max_tokens").alias("_most"), F.min("overlap_tokens").alias("_overlap"))
    df = items.select(F.col(key).alias("item_key"), F.col(text).alias("content"), "preset").join(F.broadcast(limits), "preset")
    cuts = pieces(df, "content", "_most", "_overlap").select("item_key", "content", F.size("pieces").alias("pieces"), F.posexplode("pieces").alias("piece", "p"))
    size = F.col("p.end") - F.col("p.start")
    return cuts.select(
        F.lit(kind).alias("item_kind"), "item_key", "piece", "pieces", "p.start", "p.fresh", "p.end",
        F.ceil(size / CHARS).cast("int").alias("size"), F.floor((F.col("p.fresh") - F.col("p.start")) / CHARS).cast("int").alias("overlap"),
        F.substr("content", F.col("p.start") + 1, size).alias("content"),
    )


def _all_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = read_table(spark, sf_dir, "chunk_options")
    sections = split_items(spread(read_table(spark, sf_dir, "sections")), options, "section", "section_key")
    return sections.unionByName(split_items(spread(read_table(spark, sf_dir, "chunks")), options, "chunk", "chunk_key"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pieces(spark, sf_dir).filter("pieces > 1").select("item_kind", "item_key").distinct()


def p5_piece_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces by kind of item and number of pieces: how many, their tokens, the largest and the mean overlap."""
    return (
        _all_pieces(spark, sf_dir)
        .groupBy("item_kind", "pieces")
        .agg(F.count("*").alias("n_pieces"), F.sum("size").alias("tokens"), F.max("size").alias("largest"), F.avg("overlap").alias("mean_overlap"))
    )


SQL = {
    "p5_found": """
        SELECT DISTINCT item_kind, item_key FROM (
            SELECT 'section' AS item_kind, section_key AS item_key, content, preset FROM sections
            UNION ALL SELECT 'chunk', chunk_key, content, preset FROM chunks) i
        JOIN (SELECT preset, min(max_tokens) AS most FROM chunk_options GROUP BY preset) o USING (preset)
        WHERE ceil(length(content) / 4.0) > most""",
}
