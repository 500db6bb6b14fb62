"""Training-data pipeline operators: quality, toxicity, deduplication, tokens, packing, archives, media, search.

Nothing outside this subpackage imports it.
"""
