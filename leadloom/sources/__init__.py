"""Readers, writers and the lead tables as views over the driver tables."""
