"""Column functions: text with Python semantics, lexicon flags, scores."""
