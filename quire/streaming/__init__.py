"""streaming of quire."""
