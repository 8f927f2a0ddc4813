"""Text functions as Column expressions, with the patterns that SQL shares."""
