"""orelens operators."""
