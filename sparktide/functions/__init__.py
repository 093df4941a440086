"""functions of the market signal engine."""
