"""streaming of the table-checking engine."""
