"""Training-data operators: language id, quality, dedup, decontamination, PII, licences, packing."""
