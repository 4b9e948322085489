"""Queries: the operators applied to the driver's tables."""
