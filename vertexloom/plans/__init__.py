"""Whole jobs composed of operators, and the graphs derived from the order tables."""
