"""streaming of the market signal engine."""
