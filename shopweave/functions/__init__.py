"""Column functions: pure expressions, no shuffle, no Python on the executors."""
