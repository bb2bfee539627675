"""Operators of a training-data pipeline: encoding, near-duplicates, decontamination,
toxicity, sharding, web archives, personal data, quality and language.

Nothing outside this subpackage imports it.
"""
