"""Column builders: text, numbers, dates, JSON."""
