"""Training-data operators: scans, classifiers, near-dedup, vector search, packing, tokenising.

Nothing outside this package imports it. Each module holds one operator with a general
interface; ``queries`` holds the thin registered queries over the standard tables.
"""
