"""Readers that bring landed files and driver tables into the model schemas."""
