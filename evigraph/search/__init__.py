"""Search of the engine."""
