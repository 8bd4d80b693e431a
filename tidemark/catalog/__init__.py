"""Named queries over the test tables."""

from importlib import import_module

from .base import QUERIES, SQL

for _part in ("search", "texts", "reports", "graphs", "files"):
    import_module(f".{_part}", __name__)

__all__ = ["QUERIES", "SQL"]
