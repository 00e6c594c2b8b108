"""Readers, canonicalisation, validation, and the mapping of the driver tables to transfers."""
