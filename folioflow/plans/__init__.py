"""folioflow plans."""
