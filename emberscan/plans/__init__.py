"""Registered queries. Importing this package fills the registry."""

from importlib import import_module

MODULES = ["early", "windowed", "text", "dedup", "lists", "analysis", "intake", "streams"]

for _name in MODULES:
    import_module(f"{__name__}.{_name}")

from .registry import ENTRIES  # noqa: E402,F401
