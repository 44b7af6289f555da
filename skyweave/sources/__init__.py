"""Readers and writers of the reconstruction file formats."""
