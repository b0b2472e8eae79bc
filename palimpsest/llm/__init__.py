"""Training-data operators; self-contained, nothing else in the package imports this."""
