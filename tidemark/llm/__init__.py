"""Training-data operators: extraction, filtering, near copies, tokens and language models."""
