"""Training-data operators: mixing, licences, near-duplicates, scoring, decontamination, search, tokens, pages, quality, PII.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
