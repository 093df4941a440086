"""plans of the market signal engine."""
