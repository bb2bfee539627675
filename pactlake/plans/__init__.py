"""Contracts and the rule expressions they compile to."""
