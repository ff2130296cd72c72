"""Pages judged as they arrive."""
