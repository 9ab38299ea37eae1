"""All queries of the library's own operators."""

from . import queries_af, queries_gi, queries_j  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
