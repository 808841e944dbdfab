"""Column expressions: text, deterministic hashing and vectors."""
