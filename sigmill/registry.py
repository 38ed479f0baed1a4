"""All queries of the signal operators and their SQL."""

from sigmill.plans.queries import ORACLES, QUERIES

FLAGSHIP = "a2_channel_envelope"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
