"""Operators on DataFrames: blocks, headings, sections, chunks, scores, exports, caches."""
