"""Readers and writers for edge lists, their metadata, and run tables."""
