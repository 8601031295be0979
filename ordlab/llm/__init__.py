"""Operators for building language-model training corpora.

One module per operator.  Nothing outside this package (and
``corpus_pipeline.py``) imports it.  ``catalog`` holds the registered queries.
"""
