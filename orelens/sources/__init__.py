"""orelens sources."""
