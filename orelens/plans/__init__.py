"""orelens plans."""
