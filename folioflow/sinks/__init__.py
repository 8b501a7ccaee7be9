"""folioflow sinks."""
