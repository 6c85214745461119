"""Training-data operators: dedup, filtering, mixing, packing and encoding of text corpora."""
