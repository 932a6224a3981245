"""sources of the table-checking engine."""
