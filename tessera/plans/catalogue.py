"""All queries of the engine: importing the plan modules registers them."""

from __future__ import annotations

from tessera.plans import codecs, colours, files, folds, frames, loops, rules, scenes, sequences, tables
from tessera.plans import spatial, temporal  # take the place of some plans of the others
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "codecs", "colours", "files", "folds", "frames", "loops", "rules", "scenes", "sequences", "spatial", "tables", "temporal"]
