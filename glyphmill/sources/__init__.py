"""Reading, publishing and reading back tables."""
