"""functions of the table-checking engine."""
