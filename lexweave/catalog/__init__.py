"""Runnable queries over the given tables, one or more per operator."""

from . import answers, enrichment, ingest, reports, searching  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
