"""Readers, writers and the builders that derive layout tables from plain tables."""
