"""Training-data operators: near-duplicates, quality, toxicity, packing, licences, decontamination, scoring.

Nothing else in the library imports this subpackage.
"""
