"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it, except ``__spark_entry__.py``
(behind a guard) and ``corpus_pipeline.py``.
"""
