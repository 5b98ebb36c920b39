"""Named queries and the dispatcher of operations."""
