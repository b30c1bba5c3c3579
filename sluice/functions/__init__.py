"""Value and type rules."""
