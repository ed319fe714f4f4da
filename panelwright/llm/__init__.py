"""Operators for preparing training text: filters, duplicate removal, search, mixing, packing.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
