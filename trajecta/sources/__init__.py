"""Sources of the trajectory engine."""
