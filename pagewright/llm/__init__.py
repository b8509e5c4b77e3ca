"""Training-data operators: mixing, formatting, tokens, near copies, filters and scoring."""
