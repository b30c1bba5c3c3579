"""Documents, lifecycle, checks and health."""
