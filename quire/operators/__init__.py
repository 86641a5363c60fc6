"""operators of quire."""
