"""Training-data operators: dedup, fingerprints, tokenising, packing, WARC, licences, toxicity.

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
