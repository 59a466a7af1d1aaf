"""DataFrame operators on ordered tables."""
