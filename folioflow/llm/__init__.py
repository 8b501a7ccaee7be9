"""Training-data operators: language ID, fingerprints, dedup, PII, secrets, packing, quality, mixing.

Every operator takes and returns DataFrames.
"""
