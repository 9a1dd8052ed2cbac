"""Training-data operators: duplicates, term statistics, page cleaning, tokens, mixing, canonical text."""
