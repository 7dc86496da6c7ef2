"""Reading, extracting, refreshing and writing tables."""
