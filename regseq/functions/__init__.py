"""Column functions on sequences, intervals and p-values."""
