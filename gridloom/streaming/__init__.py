"""streaming of the array engine."""
