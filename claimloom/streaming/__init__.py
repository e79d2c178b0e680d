"""Event-log operators on a batch or a stream of the same rows, and verification on arrival."""
