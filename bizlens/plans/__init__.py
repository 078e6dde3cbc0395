"""Whole reports built from the operators, and the query catalogue."""
