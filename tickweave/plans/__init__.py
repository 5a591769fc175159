"""plans of the tick-snapshot engine."""
