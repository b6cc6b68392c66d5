"""operators of the array engine."""
