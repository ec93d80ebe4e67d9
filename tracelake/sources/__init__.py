"""Readers that map stored tables to the engine's model."""
