"""Readers and writers of the formats that contracts are checked on."""
