"""Column expressions: text, numbers, times, distance, amount bins."""
