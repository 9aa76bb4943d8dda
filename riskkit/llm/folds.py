"""Held-out folds by document id."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text, modulo ``folds``, is ``fold`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
