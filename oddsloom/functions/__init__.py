"""Column functions: exact decimals, time, text and probability."""
