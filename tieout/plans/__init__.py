"""plans of the table-checking engine."""
