"""sources of the tick-snapshot engine."""
