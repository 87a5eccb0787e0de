"""Readers and writers for raw recordings, stacks, camera metadata and stage tables."""
