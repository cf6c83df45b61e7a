"""Readers and writers of the engine's own file formats, and the derived fixture tables."""
