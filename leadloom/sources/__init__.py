"""Readers, writers and record mappings."""
