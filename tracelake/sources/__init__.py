"""Readers, writers and file layouts."""
