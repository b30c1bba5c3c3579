"""State, change batches and continuous runs."""
