"""Arrow functions for what Catalyst expressions cannot say; each takes and returns whole batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import html as H
from quire.functions import ocr_rules
from quire.functions.constants import ABBREVIATIONS, LEAST_LEAD, LEAST_SHARE, LEAST_WORDS, STOPWORDS

SENTENCES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIXED = T.StructType([T.StructField("text", T.StringType()), T.StructField("layer1", T.IntegerType()), T.StructField("layer2", T.IntegerType())])


def _scalar(f: Callable, to: T.DataType):
    """An Arrow function that applies ``f`` to each value that is not null."""
    kind = _arrow_type(to)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else f(v) for v in batch.to_pylist()], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, to)


def _arrow_type(to: T.DataType) -> pa.DataType:
    if isinstance(to, T.ArrayType):
        return pa.list_(_arrow_type(to.elementType))
    if isinstance(to, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in to.fields])
    return {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64()}[type(to)]


# ---- sentences -------------------------------------------------------------------------------------

END = re.compile(r"[.!?](?=\s)")
NEXT = re.compile(r"\s+(?=[A-ZÀ-ÖØ-Þ0-9\"'(\[])")
BEFORE = re.compile(r"[a-zA-Z.]*\Z")
_short = frozenset(ABBREVIATIONS)


def split_sentences(text: str) -> list[dict]:
    """Sentences with their places.  A point ends none after an abbreviation; what follows a mark must be white
    space and a capital, a digit, a quote or an opening bracket."""
    out, start = [], 0
    for m in END.finditer(text):
        if m.start() < start:
            continue
        after = NEXT.match(text, m.end())
        if not after:
            continue
        if m[0] == ".":
            word = BEFORE.search(text[max(0, m.start() - 40) : m.start()].rstrip("."))[0].replace(".", "")
            if word.lower() in _short:
                continue
        piece = text[start : m.end()].strip()
        if piece:
            out.append({"text": piece, "start": start, "end": m.end()})
        start = after.end()
    rest = text[start:].strip()
    if rest:
        out.append({"text": rest, "start": start, "end": len(text)})
    return out


# ---- recognised text -------------------------------------------------------------------------------

_FLAGS = {"i": re.I, "m": re.M}
RULES = []
for _line in ocr_rules.RULES.strip("\n").split("\n"):
    _pattern, _flags, _to = _line.split("\t")
    _bits = 0
    for _f in _flags:
        _bits |= _FLAGS[_f]
    # words are ASCII words here, while case is that of all letters
    _pattern = _pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
    RULES.append((re.compile(_pattern, _bits), _to.replace("$1", r"\1")))
WORDS = dict(pair.split("=") for pair in ocr_rules.WORDS.split())
_any_word = re.compile(r"(?<![A-Za-z0-9_])(" + "|".join(map(re.escape, sorted(WORDS, key=len, reverse=True))) + r")(?![A-Za-z0-9_])", re.I)
_signs, _letters = re.compile(r"[=|{}\[\]<>_~^\\]"), re.compile(r"[a-záàâãéèêíïóôõúüç]", re.I)


def garbage(line: str) -> bool:
    t = line.strip()
    n, signs = len(t), len(_signs.findall(t))
    return n >= 3 and ((signs > n * 0.3 and len(_letters.findall(t)) / n < 0.4) or (n < 20 and signs > 3))


def _as_written(seen: str, right: str) -> str:
    if seen[:1].isupper() and seen[1:2] == seen[1:2].lower():
        return right[:1].upper() + right[1:]
    return right.upper() if seen == seen.upper() else right


def fix_recognised(text: str) -> dict:
    """Text without debris lines, with rules and words corrected, and how many corrections each layer made."""
    lines = text.split("\n")
    kept = [x for x in lines if not garbage(x)]
    first = len(lines) - len(kept)
    text = "\n".join(kept)
    for pattern, to in RULES:
        new = pattern.sub(to, text)
        if new != text:
            first += max(1, abs(len(text) - len(new)))
            text = new
    new = re.sub(r"\n{4,}", "\n\n\n", text)
    first += new != text
    changed: set[str] = set()

    def word(m: re.Match) -> str:
        right = _as_written(m[0], WORDS[m[0].lower()])
        if right != m[0]:
            changed.add(m[0].lower())
        return right

    return {"text": _any_word.sub(word, new), "layer1": int(first), "layer2": len(changed)}


#: One decimal, of the number's exact binary value.
one_decimal = _scalar(lambda x: f"{x:.1f}", T.StringType())
nfc = _scalar(lambda s: unicodedata.normalize("NFC", s), T.StringType())
html_to_markdown = _scalar(H.markdown, T.StringType())
html_to_standard = _scalar(lambda s: f"<article>\n{H.standard_html(s)[0]}\n</article>", T.StringType())
sentences = _scalar(split_sentences, SENTENCES)
fix_ocr = _scalar(fix_recognised, FIXED)
n_sentences = _scalar(lambda s: len(split_sentences(s)), T.IntegerType())


_token, _white = re.compile(r"[^\W\d_]+|\d{1,3}|[^\s\w]|_"), re.compile(r"[\s\ufeff]+")
_tags = re.compile(r"<[^>]+>")


def language_of(text: str) -> str:
    """The language of frequent words, or unknown; as ``text.language_scores``."""
    found = [w for w in _white.split(_tags.sub("", text).lower()) if w]
    if len(found) < LEAST_WORDS:
        return "unknown"
    (best, name), (second, _) = sorted(((sum(w in words for w in found) / len(found), k) for k, words in _stopwords.items()), key=lambda x: -x[0])[:2]
    return name if best >= LEAST_SHARE and best - second >= LEAST_LEAD else "unknown"


_stopwords = {k: frozenset(words) for k, words in STOPWORDS.items()}
count_tokens = _scalar(lambda s: len(_token.findall(s)), T.IntegerType())
detect_language = _scalar(language_of, T.StringType())


def register_sql(spark) -> None:
    """Makes the functions known to SQL by name."""
    for name, f in {"count_tokens": count_tokens, "detect_language": detect_language, "nfc": nfc, "html_to_markdown": html_to_markdown, "html_to_standard": html_to_standard, "split_sentences": sentences, "fix_ocr": fix_ocr}.items():
        spark.udf.register(name, f)
