"""Training-data operators: filtering, deduplication, packing and sharding of text corpora."""
