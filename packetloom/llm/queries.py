"""All queries of the subpackage, with their SQL."""

from __future__ import annotations

from packetloom.llm import alignment, chat, fim, fingerprints, licences, minhash_dedup, mixing, ordering, packing, pii, projection_dedup, quality, secrets  # noqa: F401
from packetloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
