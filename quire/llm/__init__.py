"""Training-data operators: language id, dedup, mixing, packing, sharding, rules, tokens, HTML, media, quality.

Nothing else in the library imports this subpackage; it stands on its own.
"""
