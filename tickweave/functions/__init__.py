"""functions of the tick-snapshot engine."""
