"""Training-data operators: fingerprints, scoring, counting, packing, de-duplication, filtering, extraction."""
