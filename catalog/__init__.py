"""Queries over the driver's tables, one per operator, with their SQL twins."""
