"""Problem 9: template residue, filler, error pages and script notices in place of content.

Every document is cut into units (lines, and sentences within lines).  What could be a field (words
enclosed by signs on both sides, a blank run) and every number is masked; what stays is the unit's
frame.  Records of one template have equal frames, so grouping by frame aligns them column by column:

* a column is a slot if its text differs between records whose frames are equal;
* what stands in the slots of several frames is a variable's name (or a blank), and the signs that
  mostly enclose names and defaults in slots are a template syntax.  No syntax and no name is given beforehand;
* a field keeps its slot unfilled if name and syntax are known, or if the syntax is and the same value,
  a default, stands in most records of the column.

One scan yields, with no text shuffled:

* the distinct frames of each document, of any length, the longest of them marked;
* the fields by frame and column;
* the words of documents in which placeholder Latin is frequent, by document.

Documents that show what stands alone ("poor") are short ones, and those of any length whose
units, each once, have no numbers and mostly stand in other documents too.  A frame is a whole-page template if it repeats and
the documents that carry it are mostly poor: error messages and notices stand alone, headings
and sentences do not.  Filler words are those that many of the placeholder-Latin documents
share; the customary placeholder words only find these documents.  A document of whatever length is residue if, apart
from its title line, menus and footers, all of its text is unfilled slots, templates or filler.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import vector as V
from quire.plans import read_table, spread, staged

#: Signs that can open and close a field (fixed values).
OPENING, CLOSING = r"{\[<«‹【〔《⟦%$#@^~=", r"}\]>»›】〕》⟧%$#@^~="
_CORE = r"[^\W_](?:[^\W_]|_(?!_))*"
#: What could be a field: one to five words between signs or underscores, or a blank run; the alignment decides.
FIELD = re.compile(
    rf"(?P<left>[{OPENING}]{{1,3}})(?P<pad>[ ]?)(?P<core>{_CORE}(?:[ ]{_CORE}){{0,4}})(?P=pad)(?P<right>[{CLOSING}]{{1,3}})"
    rf"|(?<![^\W_])__(?P<lined>{_CORE})__(?![^\W_])|(?P<blank>_{{3,}}|\[\s*\]|\{{\s*\}}|<\s*>)"
)
#: Words of the customary placeholder text (fixed values).
PLACEHOLDER_LATIN = """lorem ipsum dolor amet consectetur adipiscing elit eiusmod incididunt labore dolore magna aliqua minim veniam
nostrud exercitation ullamco laboris aliquip commodo consequat aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur
excepteur occaecat cupidatat proident culpa officia deserunt mollit anim laborum""".split()
#: Text outside slots up to which a document shows what stands alone, and, for longer ones, the share of own text.
POOR, OWN_SHARE = 420, 0.5
#: Documents that must carry a skeleton, and the share of them that must be poor.
REPEATS, POOR_SHARE = 3, 0.5
#: Placeholder Latin that makes a document a filler candidate: words, and their share.
LATIN_WORDS, LATIN_SHARE = 2, 0.04
#: Share of the candidates that must hold a word for it to be filler; share of filler in a document.
FILLER_DOCS, FILLER_SHARE = 0.1, 0.8
#: Records of equal frames in which a column must differ to be a slot; frames in whose slots a name must stand.
SLOT_RECORDS, NAME_FRAMES = 2, 2
#: Share of names and defaults among what a syntax encloses in slots; share of a column's records that makes its value a default.
SYNTAX_SHARE, DEFAULT_SHARE = 0.5, 0.5
UNIT, WORD, DOC, FIELDS = range(4)
#: Marks of units: has fields, has them among other words, of a short document, holds digits, one of the PROBES longest of its document.
HELD, FRAMED, SHORT, NUMBERED, PROBE, PROBES = 1, 2, 4, 8, 16, 2
#: Of a field, ``h`` is the frame, ``n`` the column, ``c`` the signs and ``v`` the name; ``n`` < 0 without other words in the frame.
OUT = "kind tinyint, doc bigint, h bigint, n int, c int, v bigint"
#: The signs of a blank run, whose only name is that of nothing.
BLANK = 0
_latin = np.array(sorted(V.hash_of(w) for w in PLACEHOLDER_LATIN), np.uint64)
#: The first characters of fields.
_SIGNS = np.zeros(0x110000, bool)
_SIGNS[[ord(c) for c in (OPENING + "_").replace("\\", "")]] = True
_ENDS = np.zeros(0x110000, bool)
_ENDS[[ord(c) for c in ".!?。！？।…"]] = True
_WIDE_ENDS = np.zeros(0x110000, bool)
_WIDE_ENDS[[ord(c) for c in "。！？।"]] = True


def units(cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of lines and of sentences within lines, without their marks and spaces."""
    kind = V.classes()[cp]
    space = (kind == V.SPACE) | (kind == V.BREAK)
    cut = kind == V.BREAK
    ends = np.flatnonzero(_ENDS[cp])
    after = np.minimum(ends + 1, len(cp) - 1)
    cut[ends[space[after] | _WIDE_ENDS[cp[ends]]]] = True
    label = np.zeros(len(cp), np.int64)
    np.cumsum(cut, out=label)
    label[cut] -= 1  # a mark belongs to what it ends
    ink = np.flatnonzero(~(space | _ENDS[cp]))
    if not len(ink):
        return ink, ink
    row = np.searchsorted(rows, ink, "right")
    new = np.flatnonzero(np.append(True, (np.diff(label[ink]) != 0) | (np.diff(row) != 0)))
    return ink[new], ink[np.append(new[1:] - 1, len(ink) - 1)] + 1


def _masked(text: V.Text) -> tuple[np.ndarray, np.ndarray]:
    """The code points with each number, and each word that has a digit in it, as one 0."""
    kind = V.classes()[text.cp]
    digit = kind == V.DIGIT
    if not digit.any():
        return text.cp, text.rows
    start, end = V.runs(np.where(digit, V.LETTER, kind), text.rows)
    total = np.zeros(len(digit) + 1, np.int64)
    np.cumsum(digit, out=total[1:])
    has = total[end] > total[start]
    start, end = start[has], end[has]
    cp = text.cp.copy()
    cp[start] = 48
    edge = np.zeros(len(digit) + 1, np.int64)
    np.add.at(edge, start + 1, 1)
    np.add.at(edge, end, -1)
    keep = np.cumsum(edge)[:-1] == 0
    place = np.zeros(len(digit) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return cp[keep], place[text.rows]


def _fields(body: str, found: list[tuple[int, int]]) -> str:
    """The text with fields as a mark; their (signs, name) hashes are added to ``found`` in order.

    A mark-up element that the text closes again is no field.
    """

    def field(m: re.Match) -> str:
        if m["blank"]:
            found.append((BLANK, 0))
            return "\x01"
        if m["left"] == "<" and f"</{m['core']}>" in body:
            return m[0]
        signs = "__a__" if m["lined"] else m["left"] + "a" + m["right"]
        found.append((_hash(signs), _hash((m["lined"] or m["core"]).casefold())))
        return "\x01"

    return FIELD.sub(field, body)


@lru_cache(100_000)
def _hash(text: str) -> int:
    return V.hash_of(text)


def _lines(string: str) -> list[str]:
    """Lines without the title, menus and footers; the title stays if there is nothing else."""
    lines = [x.strip() for x in string.split("\n")]
    title = len(lines) > 1 and not lines[1] and len(lines[0]) < 90 and not lines[0].endswith((".", "!", "?", "。", "！", "？", "।"))
    kept = [bool(x) and not x.startswith(("(c)", "©")) and not (" | " in x and x[0] != "|") for x in lines]
    body = [x for x, keep in zip(lines[title:], kept[title:], strict=True) if keep]
    return body or [x for x, keep in zip(lines, kept, strict=True) if keep] or [x for x in lines if x]


def _rows(kind: int, doc, h, n, c, v=None) -> pa.RecordBatch:
    m = len(h)
    names = pa.nulls(m, pa.int64()) if v is None else pa.array(np.asarray(v, np.uint64).astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, kind), pa.int8()), pa.array(np.broadcast_to(doc, m), pa.int64()), pa.array(np.asarray(h, np.uint64).astype(np.int64)), pa.array(np.broadcast_to(n, m), pa.int32()), pa.array(np.broadcast_to(c, m), pa.int32()), names],
        ["kind", "doc", "h", "n", "c", "v"],
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.asarray(batch.column(0))
        for first, part in V.slices(batch.column(1)):
            text = V.Text(part)
            n = len(text)
            if not len(text.cp):
                continue
            key = keys[first : first + n]
            signs = np.zeros(len(text.cp) + 1, np.int64)
            np.cumsum(_SIGNS[text.cp], out=signs[1:])
            has_sign = signs[text.rows[1:]] > signs[text.rows[:-1]]
            # placeholder Latin
            low = V.lower_table()[text.cp]
            start, end = V.runs(V.classes()[text.cp], text.rows)
            word = V.classes()[text.cp[start]] == V.LETTER
            start, end = start[word], end[word]
            row = text.row_of(start)
            names = V.Spans(low).of(start, end)
            at = np.minimum(np.searchsorted(_latin, names), len(_latin) - 1)
            latin = np.bincount(row, _latin[at] == names, n)
            words = np.bincount(row, minlength=n)
            filler = (latin >= LATIN_WORDS) & (latin >= LATIN_SHARE * words)
            if filler.any():
                mine = filler[row]
                pair = np.stack([row[mine].astype(np.uint64), names[mine]])
                distinct, many = np.unique(pair, axis=1, return_counts=True)
                yield _rows(WORD, key[distinct[0].astype(np.int64)], distinct[1], many, 0)
                yield _rows(DOC, key[filler], np.zeros(filler.sum()), words[filler], 0)
            # the units of all others, without furniture and each once
            of = np.flatnonzero((np.diff(text.rows) > 0) & ~filler)
            if not len(of):
                continue
            bodies, fields = [], []
            for r in of:
                body = "\n".join(_lines(text.string(text.rows[r], text.rows[r + 1])))
                bodies.append(_fields(body, fields) if has_sign[r] else body)
            found = V.Text(pa.array(bodies, pa.large_string()))
            cp, rows = _masked(found)
            s, e = units(cp, rows)
            if not len(s):
                continue
            row = np.searchsorted(rows, s, "right") - 1
            mark = np.flatnonzero(cp == 1)
            held = np.searchsorted(mark, e) > np.searchsorted(mark, s)
            short = np.bincount(row, (e - s) * ~held, len(of)) <= POOR
            names = V.Spans(cp).of(s, e)
            a, b = units(found.cp, found.rows)
            numbered = (V.Spans(found.cp).of(a, b) if len(a) == len(s) else 0) != names
            framed = held.copy()
            if len(mark) == len(fields) and len(mark):
                unit = np.searchsorted(s, mark, "right") - 1
                column = np.arange(len(mark)) - np.searchsorted(unit, unit)
                letter = np.zeros(len(cp) + 1, np.int64)
                np.cumsum(np.isin(V.classes()[cp], (V.LETTER, V.HAN, V.KANA)), out=letter[1:])
                alone = letter[e[unit]] == letter[s[unit]]
                signs_, cores = (np.array(x, np.uint64) for x in zip(*fields, strict=True))
                # a unit without other words is known by what it holds
                framed[unit[alone]] = False
                np.bitwise_xor.at(names, unit[alone], V.mix(signs_[alone] * np.uint64(31) + cores[alone]))
                yield _rows(FIELDS, key[of[row[unit]]], names[unit], np.where(alone, -1, column), (signs_ & np.uint64(0x7FFFFFFF)).astype(np.int32), cores)
            order = np.lexsort((names, row))
            first = order[np.append(True, (np.diff(row[order]) != 0) | (np.diff(names[order]) != 0))]
            # a document whose longest units do not repeat needs no more looking at
            rank = first[np.lexsort((s[first] - e[first], held[first], row[first]))]
            probe = np.zeros(len(s), bool)
            probe[rank[np.arange(len(rank)) - np.searchsorted(row[rank], row[rank]) < PROBES]] = True
            yield _rows(UNIT, key[of[row[first]]], names[first], (HELD * held + FRAMED * framed + SHORT * short[row] + NUMBERED * numbered + PROBE * probe)[first], (e - s)[first])


def unfilled(fields: DataFrame) -> DataFrame:
    """(doc, h): frames of documents that keep a slot unfilled, of (doc, h, n, c, v) as ``FIELDS`` rows have them.

    The values of each column are counted by document first; slots, names and syntaxes are found on these counts.
    """
    fields = fields.select("doc", "h", "n", "c", "v").distinct()
    values = staged(fields.groupBy("h", "n", "c", "v").agg(F.count("*").alias("docs")), "columns")
    columns = values.filter("n >= 0").groupBy("h", "n").agg(F.sum("docs").alias("all"), F.count("*").alias("many"))
    slots = values.join(columns, ["h", "n"]).select("h", "n", "c", "v", "docs", "all", ((F.col("all") >= SLOT_RECORDS) & (F.col("many") > 1)).alias("slot"))
    names = slots.filter("slot").groupBy("v").agg(F.countDistinct("h").alias("frames")).filter(F.col("frames") >= NAME_FRAMES).select("v", F.lit(True).alias("name"))
    default = (F.col("docs") >= REPEATS) & (F.col("docs") >= DEFAULT_SHARE * F.col("all"))
    named = slots.filter("slot").join(names, "v", "left").select("c", "v", "docs", (F.coalesce("name", F.lit(False)) | default).alias("known"))
    syntaxes = named.groupBy("c").agg(F.sum("docs").alias("all"), F.sum(F.when(F.col("known"), F.col("docs")).otherwise(0)).alias("good"), F.countDistinct(F.when(F.col("known"), F.col("v"))).alias("names"))
    syntaxes = syntaxes.filter((F.col("good") >= SYNTAX_SHARE * F.col("all")) & ((F.col("names") >= 2) | (F.col("c") == BLANK))).select("c")
    defaults = slots.filter(default).select("h", "n", "c", "v", F.lit(True).alias("default"))
    kept = fields.join(syntaxes, "c", "left_semi").join(names, "v", "left").join(defaults, ["h", "n", "c", "v"], "left")
    return kept.filter("name or default").select("doc", "h").distinct()


def residue_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reason): documents that are residue, once each; reason is "filler" or "template".

    Null keys and null or empty texts are no residue.  A document under several equal rows counts once.
    The counts are over all documents; the longest units of each are joined to the counts by hash, and only
    documents where these repeat (or hold fields) are judged further; no document's text is moved.
    """
    rows = spread(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null"))
    seen = staged(rows.mapInArrow(_scan, OUT), "residue")
    bit = lambda b: F.col("n").bitwiseAND(b) > 0
    every = seen.filter(F.col("kind") == UNIT)
    carriers = every.select("h", "doc", bit(SHORT).alias("short")).repartition("h").groupBy("h", "doc").agg(F.max("short").alias("short"))
    counts = carriers.groupBy("h").agg(F.count("*").alias("docs"), F.sum(F.col("short").cast("int")).alias("shorts"))
    counts = staged(counts.filter(F.col("docs") >= REPEATS), "frames")
    probes = every.filter(bit(PROBE)).select("doc", "h", bit(HELD).alias("held")).join(counts, "h", "left")
    open_ = probes.groupBy("doc").agg(F.bool_and(F.col("held") | F.col("docs").isNotNull()).alias("open")).filter("open").select("doc")
    mine = every.join(open_, "doc").groupBy("doc", "h").agg(F.max(bit(SHORT)).alias("short"), F.max(bit(NUMBERED)).alias("numbered"), F.max(bit(FRAMED)).alias("framed"), F.max("c").alias("c"))
    kept = unfilled(seen.filter(F.col("kind") == FIELDS)).withColumn("slot", F.lit(True))
    mine = staged(mine.join(counts, "h", "left").join(kept, ["doc", "h"], "left").withColumn("slot", F.coalesce("slot", F.lit(False))), "open")
    own = F.when(~F.col("slot") & (F.col("numbered") | F.col("docs").isNull()), F.col("c")).otherwise(0)
    shows = mine.filter("not short").groupBy("doc").agg(F.sum(own).alias("own"), F.sum("c").alias("size")).filter(F.col("own") <= OWN_SHARE * F.col("size")).select("doc")
    more = mine.join(shows, "doc").filter("not short").groupBy("h").agg(F.count("*").alias("more"))
    poor = F.col("shorts") + F.coalesce("more", F.lit(0))
    template = (
        mine.join(more, "h", "left")
        # text between filled fields repeats in every record of a template and shows nothing
        .withColumn("residue", F.col("slot") | (~F.col("framed") & F.coalesce(poor >= POOR_SHARE * F.col("docs"), F.lit(False))))
        .groupBy("doc")
        .agg(F.bool_and("residue").alias("all"))
        .filter("all")
        .select(F.col("doc").alias(key), F.lit("template").alias("reason"))
    )
    words = seen.filter(F.col("kind") == WORD).distinct()
    candidates = seen.filter(F.col("kind") == DOC).select("doc", F.col("n").alias("words")).distinct()
    total = candidates.count()
    vocabulary = words.groupBy("h").agg(F.count("*").alias("docs")).filter(F.col("docs") >= FILLER_DOCS * total).select("h")
    filler = (
        words.join(vocabulary, "h")
        .groupBy("doc")
        .agg(F.sum("n").alias("filler"))
        .join(candidates, "doc")
        .filter(F.col("filler") >= FILLER_SHARE * F.col("words"))
        .select(F.col("doc").alias(key), F.lit("filler").alias("reason"))
    )
    return template.unionByName(filler).groupBy(key).agg(F.min("reason").alias("reason"))


def without_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without residue documents; rows with null keys or texts stay."""
    bad = residue_documents(docs, key, text).select(F.col(key).alias("_residue"))
    return docs.join(bad, docs[key] == F.col("_residue"), "left_anti")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_documents(read_table(spark, sf_dir, "documents")).select("doc_id")
