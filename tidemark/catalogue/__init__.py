"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from tidemark.catalogue.registry import ORACLES, QUERIES

for _part in ("features", "store", "prep", "split", "windows", "compose", "metrics", "profile", "sources",
              "training", "streaming"):
    import_module(f"tidemark.catalogue.{_part}")

__all__ = ["ORACLES", "QUERIES"]
