"""Training-data operators: dedup, fingerprints, tokenising, packing, filters.

Nothing outside this subpackage imports it; ``queries.py`` lists its
registered queries.
"""
