"""Column and byte functions: regular expressions, n-grams, globs."""
