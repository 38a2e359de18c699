"""Keys, their checks, and the codec of fixed-width payloads."""
