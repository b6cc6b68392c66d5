"""functions of the array engine."""
