"""The linear programme, its solver, and experiments."""
