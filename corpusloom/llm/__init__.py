"""Training-data operators (PII, quality, packing, deduplication, ...). Nothing outside this package imports it."""
