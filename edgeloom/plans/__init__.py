"""Storage between steps, and the catalogue of queries."""
