"""CSV tables in, results out."""
