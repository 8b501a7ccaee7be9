"""folioflow functions."""
