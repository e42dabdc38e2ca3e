"""Readers, writers, catalogues and driver-side configuration."""
