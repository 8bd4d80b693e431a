"""Column functions: text, dates, vectors and model-output parsing."""
