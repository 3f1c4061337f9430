"""Column-expression helpers: grade lookups, ANSI-safe statistics, text."""

from . import grades, stats, text

__all__ = ["grades", "stats", "text"]
