"""Table schemas and the readers that produce the floor tables."""
