"""folioflow operators."""
