"""Incremental runs and streams: files that arrive, windows with late rows, scheduling of turns by key, and requests to services."""

from .incremental import run_available
from .requests import scored
from .turns import scheduled_turns
from .windows import windowed_counts

__all__ = ["run_available", "scheduled_turns", "scored", "windowed_counts"]
