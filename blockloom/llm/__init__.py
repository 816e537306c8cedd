"""Training-data operators: search, near-duplicates, scoring, packing and mixing.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` at the repository top is its only companion.
"""
