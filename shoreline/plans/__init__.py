"""Products: plans over several operators."""
