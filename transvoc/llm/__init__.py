"""Operators of a training-data pipeline, each a function on DataFrames.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
