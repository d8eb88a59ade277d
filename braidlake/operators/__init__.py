"""Operators on versioned state."""
