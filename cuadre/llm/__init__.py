"""Operators for preparing language-model training data.

Nothing outside this subpackage, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
