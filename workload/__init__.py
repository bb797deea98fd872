"""The registered queries: one per capability, each with the SQL that must agree."""

from . import chains, combining, corpora, files, graphs, profiles, reshaping, rowwise, samples, tasks  # noqa: F401
from .registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
