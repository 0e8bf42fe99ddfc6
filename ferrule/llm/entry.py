"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from importlib import import_module

MODULES = ["term_counts", "joint_rank", "set_overlaps", "near_duplicates", "group_top", "distinctive_terms", "packing", "mixing", "subject_areas"]


#: Imported at once: where one cannot be, this module cannot either, and ``__spark_entry__`` goes without the subpackage.
LOADED = [import_module(f"ferrule.llm.{m}") for m in MODULES]


def _merged(name: str) -> dict:
    return {k: v for m in LOADED for k, v in getattr(m, name).items()}


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
