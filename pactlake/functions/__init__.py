"""Scalar building blocks as Catalyst expressions: shapes, patterns, sketch buckets, hashing."""
