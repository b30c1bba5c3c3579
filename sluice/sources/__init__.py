"""Sources, change logs and targets."""
