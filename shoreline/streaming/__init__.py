"""The batch operators' state carried over unbounded input."""
