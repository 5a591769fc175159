"""operators of the tick-snapshot engine."""
