"""Named queries over the project's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ["indexing", "boolean", "evaluation", "ranking", "prediction", "structure", "learning", "formulation", "files", "streams"]


def merged(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"ferrule.catalog.{m}"), name).items()}
