"""All queries of this subpackage; importing a module registers its query."""

from fleetlens.llm import decontaminate, divergence, extraction, jaccard, langid, line_rules, mixing, pii, quality, sharding, toxicity, warc, whitening  # noqa: F401
from fleetlens.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
