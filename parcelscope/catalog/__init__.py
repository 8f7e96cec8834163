"""Named queries over the supplied tables, with the SQL each must agree with."""

from . import business, cleaning, kpis, learning, relational  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
