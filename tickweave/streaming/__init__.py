"""streaming of the tick-snapshot engine."""
