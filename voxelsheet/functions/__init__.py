"""Column helpers: geometry, scalars, flat tensors and repeatable random numbers."""
