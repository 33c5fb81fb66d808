"""Training-data operators: cleaning, deduplication, mixing and export of text corpora."""
