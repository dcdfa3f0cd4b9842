"""Table-in, table-out analytics operators."""
