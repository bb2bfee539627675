"""Contracts at the gate of a stream."""
