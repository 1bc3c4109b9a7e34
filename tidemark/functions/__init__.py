"""Column functions: market arithmetic, text, dates, metrics."""
