"""Imports every plan module."""

from . import analysis, assign, boxes, cleaning, curate, grid, joins, pixels, sources, stats, streams, tracking  # noqa: F401
