"""Readers, writers, and the catalogue of releases."""
