"""All registered queries of the library and their SQL."""

from driftlens.plans import further as _further
from driftlens.plans import more as _more
from driftlens.plans.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
assert _more and _further
