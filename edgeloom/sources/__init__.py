"""Where edges, labels, sets and patterns come from, and where they go."""
