"""Operators for preparing training text: formatting, mixing, sharding, deduplication, cleaning."""
