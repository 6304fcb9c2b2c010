"""Readers of object stores, refs, configuration and derived files."""
