"""Readers and writers of catalogs."""
