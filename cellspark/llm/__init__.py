"""Training-data operators: language ID, BPE, quality, deduplication, decontamination, sharding, URL filters."""
