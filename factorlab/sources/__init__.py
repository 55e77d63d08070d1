"""Readers and writers: text rating files and views over the driver tables."""
