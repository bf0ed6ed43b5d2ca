"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
