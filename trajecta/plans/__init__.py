"""Plans of the trajectory engine."""
