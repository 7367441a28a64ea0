"""Training-data operators: tokens, dedup, quality, language, URLs, PII, packing, top-k.

Nothing else in the package imports this subpackage.
"""
