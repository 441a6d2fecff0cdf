"""Column expressions: canonical tokens, hashes, identifiers."""
