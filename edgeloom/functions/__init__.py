"""Column functions and seeded samplers."""
