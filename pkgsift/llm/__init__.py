"""Training-data operators: quality, de-duplication, mixing, tokens, archives, search."""
