"""sources of the market signal engine."""
