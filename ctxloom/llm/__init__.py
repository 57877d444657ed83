"""Training-data operators: language ID, filtering, deduplication, tokenising and formatting."""
