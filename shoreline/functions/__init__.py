"""Column functions: time, geography, tide, datum and quality bits."""
