"""Training-data operators: fingerprints, dedup, scoring, mixing, packing, token files.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
