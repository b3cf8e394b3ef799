"""Plan construction rules."""
