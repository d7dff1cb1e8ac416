"""DataFrame operators over the floor tables."""
