"""Registered queries (one per operator family) and their SQL oracles."""

from . import catalog  # noqa: F401
from . import (columns, cleaning, derivations, rowwise_q, joins, profiles, ranking,  # noqa: F401
               splits, evaluation, prep_q, models_q)

QUERIES = catalog.QUERIES
ORACLE = catalog.ORACLE
