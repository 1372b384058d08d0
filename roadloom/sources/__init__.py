"""Readers and writers of map formats."""
