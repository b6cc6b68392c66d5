"""sources of the array engine."""
