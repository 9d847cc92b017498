"""Operators for preparing language-model training data.

Nothing outside this package imports it, except ``corpus_pipeline`` and the
guarded import in ``__spark_entry__``.
"""
