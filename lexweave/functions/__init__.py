"""Column-level functions: no shuffles, no Python in the tasks."""
