"""DataFrame -> DataFrame operators of the memory graph."""
