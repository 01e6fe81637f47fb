"""Readers, writers and the build-or-load stage."""
