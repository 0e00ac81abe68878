"""Readers and writers for movie file formats."""
