"""Fixed values that results depend on."""

#: Tags of the restricted HTML dialect (fixed values).
ALLOWED_TAGS = (
    "article section div h1 h2 h3 h4 h5 h6 p span em strong a ul ol li table thead tbody tr th td pre code blockquote br hr"
).split()

#: Frequent words by language (fixed values).
STOPWORDS = {
    "en": (
        "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she "
        "or an will my one all would there their what so up out if about who get which go me"
    ).split(),
    "pt": (
        "de a o que e do da em um para com no na uma os se mais as dos como mas foi ao ele das tem seu sua ou ser "
        "quando muito nos ja eu tambem so pelo pela ate isso ela entre era depois sem mesmo aos ter seus"
    ).split(),
    "es": (
        "de la que el en y a los del se las por un para con no una su al lo como mas pero sus le ya o este si porque "
        "esta entre cuando muy sin sobre tambien me hasta hay donde quien desde todo nos durante todos uno les ni"
    ).split(),
}
#: A language needs this share of frequent words, and this lead over the second (fixed values).
LEAST_SHARE, LEAST_LEAD, LEAST_WORDS = 0.02, 0.01, 10

#: Words before a point that ends no sentence (fixed values).
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc inc ltd co corp fig vol no dept est approx e.g i.e cf al sra srta exmo ilmo av r tel fls".split()

#: Openings of chapter titles with the level they give (fixed values).
TITLE_WORDS = ((r"^(?:part|parte)\s+", 1), (r"^(?:chapter|cap[ií]tulo)\s+", 1), (r"^(?:section|se[çc][ãa]o)\s+", 2), (r"^(?:appendix|ap[êe]ndice)\s+", 2))
#: Confidence of a heading by what shows it (fixed values).
CONFIDENCE = {"html-tag": 1.0, "linguistic": 0.8, "numbering": 0.7, "uppercase": 0.5}

#: Extensions and the formats they name (fixed values).
FORMATS = {".pdf": "pdf", ".epub": "epub", ".txt": "txt", ".text": "txt", ".html": "html", ".htm": "html", ".rtf": "rtf", ".mobi": "mobi", ".azw": "mobi", ".azw3": "mobi"}

#: Languages by the low byte of a locale number (fixed values).
LOCALES = {9: "en", 6: "es", 12: "fr", 7: "de", 16: "it", 22: "pt", 10: "ru", 17: "ja", 4: "zh", 18: "ko", 26: "ar"}

#: Cleaning level and export formats by preset (fixed values).
PRESETS = {
    "raw": {"cleaning": "light", "formats": ["md", "txt"]},
    "knowledge-base": {"cleaning": "light", "formats": ["md"]},
    "rag": {"cleaning": "standard", "formats": ["json"]},
    "fine-tuning": {"cleaning": "aggressive", "formats": ["jsonl"]},
}
#: Bounds of a chunk in tokens (fixed values).
CHUNK_MIN, CHUNK_MAX, CHUNK_TARGET = 500, 1000, 750
#: Mean confidence under which a scanned page is named (fixed value).
LOW_CONFIDENCE = 60
