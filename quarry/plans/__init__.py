"""All queries of the library outside the llm subpackage."""

from . import charts, codec, files, markup, numeric, relational, scoring, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "charts", "codec", "files", "markup", "numeric", "relational", "scoring", "text"]
