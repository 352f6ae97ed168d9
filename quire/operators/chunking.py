"""Sections of a document to chunks of bounded tokens with an overlap."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.functions.arrow import _scalar, split_sentences
from quire.functions.constants import CHUNK_MAX, CHUNK_MIN, CHUNK_TARGET

FENCE = re.compile(r"```[\s\S]*?```")
TABLE = re.compile(r"\|[^\n]+\|\n\|[\s:|-]+\|\n(?:\|[^\n]+\|\n?)*")
LIST_LINE = re.compile(r"^(?:[-*+]|\d+\.)\s")
CHUNK = T.StructType([T.StructField("content", T.StringType()), T.StructField("chapter", T.StringType()), T.StructField("section", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("overlap_tokens", T.IntegerType())])


@dataclass(frozen=True)
class ChunkOptions:
    """Bounds in tokens; ``min_tokens`` serves the scores only.  overlap is semantic, fixed or none."""

    min_tokens: int = CHUNK_MIN
    max_tokens: int = CHUNK_MAX
    target_tokens: int = CHUNK_TARGET
    overlap: str = "semantic"
    preserve_structures: bool = True

    def __post_init__(self):
        if self.target_tokens <= 0 or self.max_tokens <= 0 or self.overlap not in ("semantic", "fixed", "none"):
            raise ValueError(f"bad chunk options: {self}")


def pattern_tokens() -> Callable[[str], int]:
    """Counts of words, numbers of up to three digits and single signs; as ``text.count_pattern_tokens``."""
    import regex

    found = regex.compile(r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]")
    return lambda s: sum(1 for _ in found.finditer(s))


def segments(text: str, preserve: bool) -> list[str]:
    """Sentences, and whole fences, tables and lists where structures are kept."""
    kept: list[str] = []

    def aside(m) -> str:
        kept.append(m if isinstance(m, str) else m[0])
        return f"\x01{len(kept) - 1}\x02"

    if preserve:
        text = TABLE.sub(aside, FENCE.sub(aside, text))
        lines, run = [], []
        for line in [*text.split("\n"), None]:
            if line is not None and LIST_LINE.match(line.strip()):
                run.append(line)
                continue
            if run:
                lines.append(aside("\n".join(run)))
                run = []
            if line is not None:
                lines.append(line)
        text = "\n".join(lines)
    out = []
    for para in re.split(r"\n\n+", text):
        para = para.strip()
        if not para:
            continue
        whole = re.fullmatch("\x01(\\d+)\x02", para)
        pieces = [para] if whole else [s["text"] for s in split_sentences(para)] or [para]
        for piece in pieces:
            for _ in range(3):  # what is set aside may hold what was set aside before
                piece = re.sub("\x01(\\d+)\x02", lambda m: kept[int(m[1])], piece)
            out.append(piece)
    return out


def overlap_of(text: str, how: str) -> str:
    if how == "fixed":
        found = re.split(r"\s+", text)
        return " ".join(found[-min(-(-len(found) // 10), 50) :])
    found = split_sentences(text) if how == "semantic" else []
    return found[-1]["text"] if len(found) > 1 else ""


def fold(blocks: list[dict], o: ChunkOptions, count: Callable[[str], int]) -> list[dict]:
    """Chunks of a document's blocks in order; each begins with the overlap that the one before leaves."""
    out, carried = [], ""

    def emit(block: dict, body: str, before: str) -> str:
        content = f"{before}\n\n{body}" if before else body
        out.append({"content": content, "chapter": block["chapter"], "section": block["section"], "token_count": count(content), "overlap_tokens": count(before) if before else 0})
        return content

    for block in blocks:
        content = (block["content"] or "").strip()
        if not content:
            continue
        if count(content) <= o.max_tokens:
            emit(block, content, carried)
            carried = overlap_of(content, o.overlap)
            continue
        group: list[str] = []
        size, last = 0, ""
        for segment in segments(content, o.preserve_structures):
            n = count(segment)
            alone = n > o.max_tokens and o.preserve_structures
            if group and (alone or size + n > o.target_tokens):
                last = emit(block, " ".join(group), carried)
                carried = overlap_of(" ".join(group), o.overlap)
                group, size = [], 0
            if alone:
                last = emit(block, segment, carried)
                carried = overlap_of(segment, o.overlap)
            else:
                group.append(segment)
                size += n
        if group:
            last = emit(block, " ".join(group), carried)
        carried = overlap_of(last, o.overlap) if last else ""
    return out


def chunks(sections: DataFrame, key: str, options: ChunkOptions = ChunkOptions(), tokens: Callable[[], Callable[[str], int]] = pattern_tokens) -> DataFrame:
    """(key, index, chunk_id, total, content, chapter, section, token_count, overlap_tokens) of (key, seq, content, chapter, section).

    The fold over a document's sections is sequential, so a document's sections meet in one row; documents are spread.
    Null or blank content makes no chunk; of sections of equal seq the order is by content.  ``tokens`` makes a counter
    in each worker.
    """
    made: dict[int, Callable[[str], int]] = {}

    def run(blocks: list[dict]) -> list[dict]:
        count = made.setdefault(0, tokens())
        return fold(blocks, options, count)

    gather = F.sort_array(F.collect_list(F.struct("seq", "content", "chapter", "section")))
    per_doc = sections.filter(F.col("content").isNotNull()).groupBy(key).agg(gather.alias("_blocks"))
    cut = per_doc.select(key, F.posexplode(_scalar(run, T.ArrayType(CHUNK)).asNondeterministic()("_blocks")).alias("index", "c"))
    return numbered(cut.select(key, "index", "c.*"), key)


def numbered(rows: DataFrame, key: str, index: str = "index") -> DataFrame:
    """Adds chunk_id (chunk-001, ...) and total to rows with an index from 0."""
    return rows.withColumn("chunk_id", F.format_string("chunk-%03d", F.col(index) + 1)).withColumn("total", F.count("*").over(W.partitionBy(key)))


def list_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run_no, n_lines): runs of successive list lines, numbered in order."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = W.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("item", X.trim(F.col("line")).rlike(r"^(?:[-*+]|\d+\.)\s"))
    rows = rows.withColumn("_new", (F.col("item") & ~F.coalesce(F.lag("item").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("run_no", F.sum("_new").over(w)).filter("item")
    return rows.groupBy(key, "run_no").agg(F.count("*").alias("n_lines"))


