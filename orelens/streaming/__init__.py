"""orelens streaming."""
