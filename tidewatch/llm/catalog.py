"""All queries of this subpackage, by operator."""

from tidewatch.llm import (  # noqa: F401
    decontaminate, forest, langid, mixing, neardup, periods, pii, quality, ranking, secrets, substrings, tokencount, warc)
from tidewatch.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
