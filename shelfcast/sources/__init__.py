"""Schemas, layer tables, raw files and the mapping of the driver's tables."""
