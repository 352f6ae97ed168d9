"""Problem 4: one consistent form for text that reads the same but is stored in different characters.

The Arrow buffer of a batch becomes one code-point array.  A lookup table names the
characters that stand for others (full-width and half-width forms, ligatures, Kangxi
radicals, kinds of space) or for nothing (zero-width characters, soft hyphens); gathers
and running offsets write the expanded array, marks are brought into canonical order and
composed by searches in the sorted table of composable pairs, and look-alike letters take
the script of their word.  No step calls string functions per row.

Superscripts, circled forms and fractions look different and stay.  Joiners stay between
letters of scripts that need them.  Hangul jamo stay as they are.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import vector as V
from quire.plans import read_table, spread, staged

#: Compatibility forms that look like what they stand for (fixed values).
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<small>", "<vertical>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Characters without width or ink (fixed values).
NO_INK = "­͏؜ᅟᅠ឴឵᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
JOINERS = "‌‍"
#: Letters that look the same: Latin, Cyrillic, Greek; a dot where a script has none (fixed values).
LOOK_ALIKES = """
a а .  c с .  d ԁ .  e е .  h һ .  i і .  j ј .  o о ο  p р .  q ԛ .  s ѕ .  v ѵ .  w ԝ .  x х .  y у .
A А Α  B В Β  C С .  E Е Ε  H Н Η  I І Ι  J Ј .  K К Κ  M М Μ  N . Ν  O О Ο  P Р Ρ  S Ѕ .  T Т Τ  X Х Χ  Y Ү Υ  Z . Ζ
ë ё .  Ë Ё .  ï ї .  Ï Ї Ϊ  ó . ό
"""
LATIN, CYRILLIC, GREEK = 1, 2, 3


@lru_cache(1)
def fold_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, size, codes: character c with size[c] >= 0 becomes codes[first[c] : first[c] + size[c]]."""
    first, size, codes = np.zeros(0x110000, np.int32), np.full(0x110000, -1, np.int32), []
    for c in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)):
        ch = chr(c)
        to = unicodedata.normalize("NFC", ch)
        tag = unicodedata.decomposition(ch).split(" ")[0]
        if tag in SAME_LOOK:
            full = unicodedata.normalize("NFKC", ch)
            # spacing accents decompose to a space and a mark; they stay
            to = to if full[:1] == " " and len(full) > 1 else full
        if ch in NO_INK:
            to = ""
        if c in (0x2010, 0x2011):
            to = "-"
        if c in (0x2028, 0x2029, 0x85):
            to = "\n"
        if to != ch:
            first[c], size[c] = len(codes), len(to)
            codes.extend(map(ord, to))
    return first, size, np.asarray(codes or [0], np.uint32)


@lru_cache(1)
def compose_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (first << 32 | second), composites, and combining classes by code point."""
    pairs = {}
    ccc = np.zeros(0x110000, np.uint8)
    for c in (*range(0xC0, 0xD800), *range(0xF900, 0x12000)):
        ch = chr(c)
        ccc[c] = unicodedata.combining(ch)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            pairs[int(parts[0], 16) << 32 | int(parts[1], 16)] = c
    keys = np.asarray(sorted(pairs), np.uint64)
    return keys, np.asarray([pairs[int(k)] for k in keys], np.uint32), ccc


@lru_cache(1)
def split_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, size, codes of the full decomposition of each composite (size 0: none)."""
    first, size, codes = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32), []
    for c in compose_table()[1]:
        parts = unicodedata.normalize("NFD", chr(c))
        first[c], size[c] = len(codes), len(parts)
        codes.extend(map(ord, parts))
    return first, size, np.asarray(codes or [0], np.uint32)


@lru_cache(1)
def script_tables() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The script of each letter that has no look-alike (8 + script of one that has), and maps into each script."""
    script = np.zeros(0x110000, np.uint8)
    for c in range(0x41, 0x530):
        if unicodedata.category(chr(c))[0] == "L":
            name = unicodedata.name(chr(c), "")
            script[c] = next((k for k, s in ((LATIN, "LATIN"), (CYRILLIC, "CYRILLIC"), (GREEK, "GREEK")) if name.startswith(s)), 0)
    script[0x1E00:0x1F00] = LATIN
    script[0x1F00:0x2000] = GREEK
    to = {k: np.arange(0x530, dtype=np.uint32) for k in (LATIN, CYRILLIC, GREEK)}
    words = LOOK_ALIKES.split()
    for row in zip(words[::3], words[1::3], words[2::3], strict=True):
        have = [(k, ord(ch)) for k, ch in zip((LATIN, CYRILLIC, GREEK), row, strict=True) if ch != "."]
        for _, c in have:
            script[c] = 8 + have[[x for _, x in have].index(c)][0]
            for k, d in have:
                to[k][c] = d
    return script, to


def _rewrite(cp: np.ndarray, rows: np.ndarray, at: np.ndarray, width: np.ndarray, first: np.ndarray, size: np.ndarray, codes: np.ndarray):
    """Replace the spans [at, at + width) by codes[first : first + size]; returns the new array and row offsets."""
    if not len(at):
        return cp, rows
    many = np.ones(len(cp), np.int64)
    inside = np.repeat(at, width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
    many[inside] = 0
    keep = many > 0
    many[at] = size
    place = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(many, out=place[1:])
    out = np.empty(place[-1], np.uint32)
    out[place[:-1][keep]] = cp[keep]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place[at], size) + step] = codes[np.repeat(first, size) + step]
    return out, place[rows]


def _entities(cp: np.ndarray, rows: np.ndarray):
    """Character references by what they show; those for < > & by their usual names."""
    at = np.flatnonzero(cp == ord("&"))
    if not len(at):
        return cp, rows
    ends = np.flatnonzero(cp == ord(";"))
    pick = np.searchsorted(ends, at)
    at, pick = at[pick < len(ends)], pick[pick < len(ends)]
    width = ends[pick] - at + 1 if len(at) else at
    row_end = rows[np.searchsorted(rows, at, "right")] if len(at) else at
    ok = (width <= 34) & (at + width <= row_end)
    at, width = at[ok], width[ok]
    if not len(at):
        return cp, rows
    names = V.Spans(cp).of(at, at + width)
    distinct, first_seen, code = np.unique(names, return_index=True, return_inverse=True)
    first, size, codes = [], [], []
    for k in first_seen:
        written = cp[at[k] : at[k] + width[k]].tobytes().decode("utf-32-le")
        shown = html.unescape(written)
        shown = {"<": "&lt;", ">": "&gt;", "&": "&amp;"}.get(shown, shown)
        first.append(len(codes))
        size.append(len(shown))
        codes.extend(map(ord, shown))
    first, size = np.asarray(first), np.asarray(size)
    return _rewrite(cp, rows, at, width, first[code], size[code], np.asarray(codes or [0], np.uint32))


def _joiners(cp: np.ndarray, rows: np.ndarray):
    """Drop joiners that follow no letter of an Indic or Arabic script."""
    at = np.flatnonzero((cp == 0x200C) | (cp == 0x200D))
    if len(at):
        before = cp[np.maximum(at - 1, 0)]
        need = ((before >= 0x600) & (before < 0x1000)) & (at > 0)
        at = at[~need]
    none = np.zeros(len(at), np.int64)
    return _rewrite(cp, rows, at, none + 1, none, none, np.zeros(1, np.uint32))


def _compose(cp: np.ndarray, rows: np.ndarray):
    keys, composite, ccc = compose_table()
    first, size, codes = split_table()
    # a composite before a mark is taken apart, as the mark may belong between its parts
    mark = ccc[cp] > 0
    before = np.flatnonzero(mark[1:] & (size[cp[:-1]] > 0)) if len(cp) > 1 else np.zeros(0, np.int64)
    cp, rows = _rewrite(cp, rows, before, np.ones(len(before), np.int64), first[cp[before]], size[cp[before]], codes)
    cp = cp.copy()
    while True:
        kind = ccc[cp]
        # marks of class 0 that compose (as Indic length marks) are reached as the second of an adjacent pair
        at = np.flatnonzero(kind > 0) if len(cp) else np.zeros(0, np.int64)
        if not len(at):
            return cp, rows
        heads = np.zeros(len(cp) + 1, bool)
        heads[rows] = True
        run = np.flatnonzero(np.append(True, (np.diff(at) > 1) | heads[at[1:]]))
        lead = at[run]  # the first mark of each run; its starter stands before it
        of = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(at))))
        order = np.lexsort((at, kind[at], of))
        if (order != np.arange(len(at))).any():
            cp[at] = cp[at[order]]
            kind[at] = kind[at[order]]
        starter = lead[of] - 1
        ok = (starter >= 0) & ~heads[lead][of]
        previous = kind[np.maximum(at - 1, 0)]
        ok &= (at - 1 == starter) | (previous < kind[at])
        key = cp[np.maximum(starter, 0)].astype(np.uint64) << np.uint64(32) | cp[at].astype(np.uint64)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok &= keys[place] == key
        hit = np.flatnonzero(ok)
        if not len(hit):
            return cp, rows
        _, one = np.unique(starter[hit], return_index=True)
        hit = hit[one]
        cp[starter[hit]] = composite[place[hit]]
        none = np.zeros(len(hit), np.int64)
        cp, rows = _rewrite(cp, rows, at[hit], none + 1, none, none, np.zeros(1, np.uint32))


def _scripts(cp: np.ndarray, rows: np.ndarray):
    """Give look-alike letters the script that the other letters of their word have, else those of the row."""
    table, to = script_tables()
    kind = table[cp]
    alike = kind >= 8
    if not (alike.any() and ((kind & 7) > 1).any()):
        return cp
    letter = V.classes()[cp] == V.LETTER
    start, end = V.runs(letter.view(np.uint8), rows)
    word = letter[start]
    start, end = start[word], end[word]
    if not len(start):
        return cp

    def numbers(of_kind: int) -> np.ndarray:
        total = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(kind == of_kind, out=total[1:])
        return total

    plain = {k: numbers(k) for k in (LATIN, CYRILLIC, GREEK)}
    in_row = np.searchsorted(rows, start, "right") - 1
    best = np.zeros(len(start), np.int64)
    most = np.zeros(len(start), np.int64)
    for source_start, source_end in ((start, end), (rows[in_row], rows[in_row + 1])):
        open_ = best == 0
        top = np.stack([plain[k][source_end] - plain[k][source_start] for k in (LATIN, CYRILLIC, GREEK)])
        order = np.sort(top, axis=0)
        clear = open_ & (order[2] > order[1])
        best[clear] = top.argmax(axis=0)[clear] + 1
        most = np.maximum(most, order[2])
    best[best == 0] = LATIN
    where = np.repeat(best, end - start)
    inside = np.repeat(start, end - start) + (np.arange((end - start).sum()) - np.repeat(np.cumsum(end - start) - (end - start), end - start))
    out = cp.copy()
    for k in (LATIN, CYRILLIC, GREEK):
        mine = inside[(where == k) & alike[inside]]
        out[mine] = to[k][out[mine]]
    return out


def canonical(array: pa.Array, markup: bool = False) -> pa.Array:
    """The consistent form of each text; null where the text is null or already has that form."""
    parts = []
    for _, part in V.slices(array):
        size = np.asarray(pc.fill_null(pc.binary_length(part), 0))
        wide = np.asarray(pc.fill_null(pc.utf8_length(part), 0)) != size
        if markup:
            wide |= np.asarray(pc.fill_null(pc.match_substring(part, "&"), False))
        index = np.flatnonzero(wide)
        if not len(index):
            parts.append(pa.nulls(len(part), pa.large_string()))
            continue
        some = part.take(pa.array(index))
        text = V.Text(some)
        cp, rows = text.cp, text.rows
        if markup:
            cp, rows = _entities(cp, rows)
        first, size_of, codes = fold_table()
        at = np.flatnonzero(size_of[cp] >= 0)
        cp, rows = _rewrite(cp, rows, at, np.ones(len(at), np.int64), first[cp[at]], size_of[cp[at]], codes)
        cp, rows = _joiners(cp, rows)
        cp = _scripts(cp, rows)  # before marks join their letters, so that a letter and its mark become one script's character
        cp, rows = _compose(cp, rows)
        new = V.to_array(cp, rows)
        changed = pc.not_equal(new, some)
        new = pc.if_else(changed, new, pa.scalar(None, pa.large_string()))
        spread_ = np.full(len(part), -1, np.int64)
        spread_[index] = np.arange(len(index))
        parts.append(new.take(pa.array(spread_, mask=spread_ < 0)))
    return pa.chunked_array(parts, pa.large_string()).combine_chunks() if parts else pa.array([], pa.large_string())


@F.arrow_udf(T.StringType())
def _canonical_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield _one(canonical(batch)).cast(pa.string())


@F.arrow_udf(T.StringType())
def _canonical_html(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield _one(canonical(batch, True)).cast(pa.string())


def _one(array) -> pa.Array:
    return pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array


def with_canonical(df: DataFrame, column: str, into: str = "canonical", markup: bool = False) -> DataFrame:
    """``df`` with the consistent form of ``column`` in ``into`` (replacing a column of that name).

    Null stays null, empty text stays empty, repeated rows get the same form.  The Python side returns
    only texts that change; the rest never crosses back.
    """
    new = (_canonical_html if markup else _canonical_text)(F.col(column))
    return df.withColumn(into, F.coalesce(new, F.col(column)))


def same_look(df: DataFrame, key: str, column: str, field: str, markup: bool = False) -> DataFrame:
    """Pairs (field, key_a, key_b), key_a < key_b, of rows whose texts look the same but differ in storage.

    Of the texts of one form at most one is the form itself, so every pair has a row that the
    operator changes: the changed rows, few, are joined to all rows by two 64-bit hashes of the form.
    Rows with null keys or texts belong to no pair; repeated rows count once.  A form that a third
    of all rows share is split by the adaptive skew join, and only pairs that differ are made.
    """
    new = (_canonical_html if markup else _canonical_text)(F.col(column))
    form = F.coalesce(F.col("_new"), F.col(column))
    rows = (
        spread(df.select(key, column).filter(F.col(key).isNotNull() & F.col(column).isNotNull()))
        .withColumn("_new", new)
        .select(F.col(key).alias("k"), F.xxhash64(form).alias("h1"), F.xxhash64(F.lit(field), form).alias("h2"), F.xxhash64(column).alias("raw"), F.col("_new").isNotNull().alias("changed"))
    )
    rows = staged(rows, f"forms-{field}")
    a, b = rows.filter("changed").alias("a"), rows.alias("b")
    pair = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("a.raw") != F.col("b.raw")) & (F.col("a.k") != F.col("b.k")) & (~F.col("b.changed") | (F.col("a.k") < F.col("b.k"))))
    return pair.select(F.lit(field).alias("field"), F.least("a.k", "b.k").alias("key_a"), F.greatest("a.k", "b.k").alias("key_b")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = same_look(read_table(spark, sf_dir, "chunks"), "chunk_key", "content", "content")
    pages = same_look(read_table(spark, sf_dir, "extraction_results"), "extraction_id", "html", "html", markup=True)
    return chunks.unionByName(pages)
