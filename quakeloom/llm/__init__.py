"""Operators of a training-data pipeline: scoring, counting, extraction, duplicates, language, packing.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the entry module do.
"""
