"""sources of arcweave."""
