"""quire: a document-processing engine on Spark DataFrames.

Raw files, web pages, books and scanned pages become normalised text, sections,
bounded chunks, quality scores and exports.  Every stage is a DataFrame
transformation, so the same plan runs on one document or on a corpus.
"""

__version__ = "0.1.0"
