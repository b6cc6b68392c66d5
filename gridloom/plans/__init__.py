"""plans of the array engine."""
