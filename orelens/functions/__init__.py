"""orelens functions."""
