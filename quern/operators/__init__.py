"""Index, search, presentation and cache operators."""
