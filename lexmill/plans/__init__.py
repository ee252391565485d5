"""Named queries.  Importing this package fills the registry."""

from . import analysis, assessment, dialogue, retrieval, service, streams, text, web  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
