"""Index building, search, statistics and collection operators."""
