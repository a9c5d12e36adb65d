"""Training-data operators: deduplication, language, quality, toxicity, tokens, packing, search.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` registers the thin query of each one.
"""
