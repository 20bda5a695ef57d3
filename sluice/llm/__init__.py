"""Training-data operators: quality, decontamination, rules, token output, PII, WARC, packing, toxicity, near and line duplicates.

Nothing else in the library imports this subpackage; removing its folder leaves
the rest of the library whole.
"""
