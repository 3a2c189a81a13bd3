"""Training-data operators: tokenising, deduplication, filtering, packing.

Nothing outside this subpackage imports it, so the screening engine works
without it.
"""
