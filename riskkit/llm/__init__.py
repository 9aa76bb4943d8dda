"""Operators for preparing language-model training data, each a Spark job over whole tables.

Every module holds one operator with its own general interface and, at its end,
the registered query that applies it to the driver's tables.  Nothing outside
this subpackage imports it.
"""

from . import (chat_format, exact_topk, filter_audit, language_crf, merkle, quality, sentence_pieces,  # noqa: F401
               simhash_groups, source_mix, spot_signatures, suffix_dedup, toxicity, url_filter)
from .catalog import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
