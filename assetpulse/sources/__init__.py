"""Readers, writers and the readings data source."""
