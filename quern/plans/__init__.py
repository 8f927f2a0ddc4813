"""Plan helpers: shared storage between jobs and Arrow batch slicing."""
