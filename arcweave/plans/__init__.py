"""plans of arcweave."""
