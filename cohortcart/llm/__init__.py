"""Operators for preparing language-model training data.

One module per operator; ``queries`` registers one query for each.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
