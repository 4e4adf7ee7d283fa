"""Training-data operators: deduplication, tagging, scanning, sharding, mixing, packing and fingerprints."""
