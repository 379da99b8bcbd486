"""Reading, writing and moving tables."""
