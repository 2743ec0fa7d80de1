"""Training-data operators (near-duplicates, packing, extraction, scoring, mixing, search).

Nothing outside this subpackage imports it.
"""
