"""operators of the table-checking engine."""
