"""Training-data operators: search, scoring, media, filtering, deduplication, archives, tokens, mixing, privacy.

Nothing outside this subpackage imports it.
"""
