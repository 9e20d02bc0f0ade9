"""Readers, writers and the model views over the star-schema tables."""
