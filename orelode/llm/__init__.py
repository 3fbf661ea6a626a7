"""Training-data operators: one module for each, all DataFrame in, DataFrame out.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
