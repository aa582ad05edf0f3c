"""Training-data operators: cleaning, deduplication, scanning, mixing and packing of text corpora."""
