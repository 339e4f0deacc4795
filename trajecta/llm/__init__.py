"""Training-data operators: scoring, filtering, extraction, matching and packing of text corpora."""
