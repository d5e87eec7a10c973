"""Training-data operators: search, filtering, deduplication, packing and tokenising at corpus scale."""
