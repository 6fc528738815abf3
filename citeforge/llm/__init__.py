"""Training-data operators: cleaning, deduplication, tokenising, packing, search and scans."""
