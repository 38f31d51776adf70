"""Training-data operators (language, toxicity, decontamination, tokens, URLs,
secrets, near-duplicates, personal data, quality, vector search).

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
