"""Readers and deterministic generators."""
