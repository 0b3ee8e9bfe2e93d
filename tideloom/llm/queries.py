"""Importing this module registers every query of the subpackage."""

from tideloom.llm import chat_format, decontaminate, exact_dedup, html_extract, langid, minhash, mixing, pii, sharding, simhash, spelling, toxicity, whitening  # noqa: F401
from tideloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
