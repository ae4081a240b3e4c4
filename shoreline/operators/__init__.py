"""Relational operators over water levels, terrain, nodes and cells."""
