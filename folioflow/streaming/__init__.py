"""folioflow streaming."""
