"""operators of the market signal engine."""
