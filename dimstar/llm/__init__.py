"""Training-data operators: quality, deduplication, scanning, tokenising, packing and formatting of texts.

Nothing outside this subpackage imports it, and `corpus_pipeline.py` at the top of the repository composes it.
"""
