"""Column functions: text, language, quality, hashing."""
