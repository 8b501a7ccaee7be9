"""folioflow sources."""
