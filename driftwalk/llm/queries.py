"""All queries of this subpackage, with the SQL that checks them."""

from driftwalk.llm import (  # noqa: F401  (each registers its query)
    alignment,
    bpe,
    chat_format,
    decontamination,
    filter_audit,
    line_dedup,
    minhash,
    nearest,
    personal,
    quality,
    sharding,
    token_counts,
    warc,
)
from driftwalk.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
