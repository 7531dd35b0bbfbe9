"""Detail rows as a stream."""
